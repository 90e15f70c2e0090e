"""Toxicity, quality rules, token records, packing, decontamination: brute force and edge cases."""

import math
import zlib

import numpy as np
import pytest
from conftest import SF
from llm.edges import edge_docs, empty_like
from pyspark.sql import functions as F

from quarry.llm import decontam, outliers, packing, tokenfile, toxicity
from quarry.llm.queries import TOKENIZER
from quarry.llm.tokens import encoder

# Toxicity ---------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("YOU 1D10T!") == " you idiot "
    assert toxicity.fold("іdіоt") == " idiot "  # letters of another script
    assert toxicity.fold("pay $5 at 10:30, st0p.").split() == ["pay", "at", "stop"]
    assert toxicity.fold(None) == " " and toxicity.fold("").strip() == ""


def test_matching_and_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " idio": 2.0, " idiot ": 4.0}, {"trash can"})
    a = lexicon.automaton()
    assert sorted(toxicity.matches(toxicity.fold("an idiot, idiotic trash"), a).values()) == [2.0, 3.0, 4.0]
    assert not toxicity.matches(toxicity.fold("the trash can"), a)
    assert not toxicity.matches(" ", toxicity.Lexicon().automaton())


def test_exceptions_beside_a_slow_search():
    rng = np.random.default_rng(5)
    words = ["ab", "cd", "ef", "gh"]
    lexicon = toxicity.Lexicon({" ab ": 1.0, " cd ": 2.0, " ef": 3.0}, {"ab cd", "cd ef", "gh ab"})
    a = lexicon.automaton()
    for _ in range(300):
        said = [words[i] for i in rng.integers(0, 4, rng.integers(0, 12))]
        spared = {k + d for k in range(len(said) - 1) if f"{said[k]} {said[k + 1]}" in lexicon.exceptions for d in (0, 1)}
        want = {3 * k: {"ab": 1.0, "cd": 2.0, "ef": 3.0}[w] for k, w in enumerate(said) if w != "gh" and k not in spared}
        folded = f" {' '.join(said)} "
        assert toxicity.matches(folded, a) == want, said
        bigrams = {f"{said[i]} {said[i + 1]}" for i in range(len(said) - 1) if 3 * i in want or 3 * i + 3 in want}
        assert toxicity.matched_phrases(folded, want) == bigrams


def test_many_exceptions_take_linear_time():
    import time

    lexicon = toxicity.Lexicon({" trash ": 3.0}, {"trash can"})
    a, took = lexicon.automaton(), []
    for n in (50_000, 200_000):
        folded = toxicity.fold("trash can and trash " * n)
        began = time.process_time()
        assert len(toxicity.matches(folded, a)) == n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_scores_find_held_out_labels(spark):
    folder = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity.toxicity_scores(docs, labels)
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) >= 0.9 and out.count() == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out.collect())


def test_toxicity_edges(spark):
    docs = edge_docs(spark).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity_scores(empty_like(docs), labels).count() == 0
    assert toxicity.toxicity_scores(docs, empty_like(labels)).count() == docs.count()


# Quality rules ------------------------------------------------------------------------------


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c a b c", "a a a a", "x\n\nx\n x\nx y", "é#ß* über|<>", "a b c d a b c e a b c", "one two three", "a\x0bb\x0cc d\x85e"])
def test_counts(text):
    assert outliers.text_counts(text.encode() if text is not None else None) == slow_counts(text)


def test_counts_of_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for r in rows:
        if len(r["text"]) < 4000:
            assert outliers.text_counts(r["text"].encode()) == slow_counts(r["text"])


def test_chi2():
    assert math.isclose(outliers.chi2_quantile(0.95, 4), 9.487729, rel_tol=1e-5)


def slow_mcd(x, h=0.75, outer=0.975, trials=60):
    """Another minimum covariance determinant: random starts of few rows, steps on exactly the nearest
    rows until the determinant stops falling, the least of all, reweighted.  Distances of all rows."""
    rng = np.random.default_rng(1)
    n, dim = x.shape
    size = math.ceil(h * n)
    floor = np.sqrt(outliers.FLOOR)

    def scatter(rows, factor):
        cov = np.cov(rows.T, bias=True) * factor
        root = np.maximum(np.sqrt(np.diag(cov)), floor)
        corr = cov / np.outer(root, root)
        corr[np.diag_indices(dim)] = 1
        for share in np.linspace(1, 0, 2001):  # the first share of the correlations that is conditioned well
            tried = share * corr + (1 - share) * np.eye(dim)
            if np.linalg.cond(tried) <= outliers.CONDITION * (1 + 1e-9):
                break
        return rows.mean(0), tried * np.outer(root, root)

    def distances(mean, cov):
        away = x - mean
        return np.einsum("ij,ij->i", away @ np.linalg.inv(cov), away)

    def factor(share):
        q = outliers.chi2_quantile(share, dim)
        return share / (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8))  # chi-square of dim + 2 = 6

    best = None
    for _ in range(trials):
        mean, cov = scatter(x[rng.choice(n, dim + 1, replace=False)], 1.0)
        last = math.inf
        while True:
            mean, cov = scatter(x[np.argsort(distances(mean, cov), kind="stable")[:size]], factor(h))
            det = np.linalg.slogdet(cov)[1]
            if det >= last - 1e-9:
                break
            last = det
        if best is None or last < best[0]:
            best = last, mean, cov
    near = distances(*best[1:]) <= outliers.chi2_quantile(outer, dim)
    return distances(*scatter(x[near], factor(outer))), int(near.sum()), best[0]


def table_of(spark, x, source="s"):
    return spark.createDataFrame([("en", source, *map(float, r)) for r in x], "lang string, source string, x0 double, x1 double, x2 double, x3 double")


def mixture(n, odd, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.normal(0, 1, (4, 4)) * 0.3 + np.eye(4)
    clean = rng.normal(0, 1, (n, 4)) @ mix * [0.2, 0.1, 0.3, 0.15] + [1.6, 0.4, 0.3, 0.1]
    return np.vstack([clean, rng.normal([3, 1.9, 0.3, 0.1], 0.02, (odd, 4))])


@pytest.mark.parametrize(("n", "odd"), [(800, 200), (90, 20), (24, 4), (400, 0)])
def test_robust_estimate(spark, n, odd):
    """Rows far off, up to a fifth and close together, don't move the estimate, and are far from it."""
    x = mixture(n, odd)
    df = table_of(spark, x)
    fitted = outliers.concentrate(df)
    got = np.array([r["d"] for r in outliers.matched(df, fitted).select(outliers.squared_distance().alias("d")).collect()])
    away, used, _ = slow_mcd(x)
    assert abs(fitted.first()["used"] - used) <= 1 + n // 100
    limit = outliers.outside_limit(used, 1 - 1e-6)
    assert ((got > limit) == (away > limit)).mean() >= 1 - 1 / n
    assert np.corrcoef(np.log(got), np.log(away))[0, 1] > 0.99 and (got[n:] > limit).all()


def test_start_of_smallest_determinant_wins():
    """Where one start ends in a worse subset, another one's estimate is taken."""
    x = mixture(150, 40, seed=8)
    held = lambda values, d2, also=None: outliers._held_sums(values, d2, also)
    best = slow_mcd(x, trials=200)[2]
    mid, spread = np.median(x, 0), np.maximum(np.median(np.abs(x - np.median(x, 0)), 0) * 1.4826, 0.01)
    z = (x - mid) / spread
    length = np.sqrt((z**2).sum(1))
    ends = []
    for fit in outliers.starts(held(z, length**2, {"t": np.tanh(z), "u": z / length[:, None]}), mid, spread):
        steps = [fit["det"]]
        while (after := outliers.nearest_estimate(held(x, outliers._held_distance(x, fit)), 0.75))["det"] < steps[-1] - outliers.GAIN:
            fit = after
            steps.append(fit["det"])
        assert len(steps) > 1 and steps == sorted(steps, reverse=True)
        ends.append(steps[-1])
    assert len(ends) == len(outliers.STARTS) and min(ends) <= best + 0.05


def test_groups_beyond_a_task_take_the_same_steps(spark):
    df = table_of(spark, mixture(300, 60), "a").union(table_of(spark, mixture(40, 5, seed=4), None)).union(table_of(spark, np.ones((12, 4)), "same"))
    whole, split = ({r["source"]: r.asDict() for r in outliers.concentrate(df, in_task=n).collect()} for n in (1000, 0))
    assert whole.keys() == split.keys() == {"a", None, "same"}
    for source, row in whole.items():
        for k, v in row.items():
            if k not in ("lang", "source", "start", "done"):
                assert math.isclose(v, split[source][k], rel_tol=1e-6, abs_tol=1e-6), (source, k)


def test_limit_is_the_chi_square_quantile_for_many_rows():
    assert math.isclose(outliers.outside_limit(10**8, 0.99), outliers.chi2_quantile(0.99, 4), rel_tol=1e-5)
    assert outliers.outside_limit(20, 1 - 1e-6) > 2 * outliers.outside_limit(200, 1 - 1e-6)
    # The 0.95 quantile of F(4, 10) is 3.478.
    assert math.isclose(outliers.outside_limit(14, 0.95), 15 * 13 * 4 / (14 * 10) * 3.47805, rel_tol=1e-4)


def test_base_counts_in_sql(spark):
    """The base counts of whole texts, said in SQL."""
    from compare import duck

    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    sql = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {words} AS w FROM documents),
     g AS (SELECT doc_id, k, w[k:k + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
     m AS (SELECT doc_id, unnest([k, k + 1, k + 2]) AS i FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
     r AS (SELECT doc_id, count(DISTINCT i) AS n FROM m GROUP BY doc_id),
     l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT d.doc_id, len(w), length(array_to_string(w, '')), length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), coalesce(l.n, 0), coalesce(r.n, 0)
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) ORDER BY doc_id"""
    want = duck(SF).execute(sql).fetchall()
    got = outliers.quality_verdicts(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert [tuple(r) for r in got] == want


def ordinary(n, seed=6):
    """Texts of 60 to 600 words in lines of about a dozen, hardly a repetition in them."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))
    return ["\n".join(" ".join(word() for _ in range(rng.integers(5, 20))) for _ in range(rng.integers(6, 50))) for _ in range(n)]


def with_defects(text):
    """One text with each kind of defect alone: words repeated, lines repeated, symbols, long words."""
    words, lines = text.split(), text.split("\n")
    half = int(len(words) * 0.24)
    return {
        "words": " ".join(words + words[:half] * 2),  # under the base rule's 50 per cent
        "lines": "\n".join([*lines, *[f"x{k % 26}" for k in range(4 * len(lines))]]),
        "symbols": "\n".join(x + " #$%" for x in lines),
        "long": " ".join(a + b for a, b in zip(words[::2], words[1::2], strict=False)),
    }


def test_each_defect_alone_is_rejected(spark):
    texts = ordinary(400)
    odd = with_defects(max(texts[:50], key=len))
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(1000 + k, t, "en", "s") for k, t in enumerate(odd.values())]
    got = {r["doc_id"]: r for r in outliers.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[k]["kept"] for k in range(400)) >= 398
    for k, name in enumerate(odd):
        assert not got[1000 + k]["base_failed"] and not got[1000 + k]["kept"], (name, got[1000 + k])


@pytest.mark.parametrize("n", [40, 200])
def test_small_sources_are_judged(spark, n):
    """By their language's rows, or by all: in a table of few rows too, and whatever sources are called."""
    texts = ordinary(n)
    odd = with_defects(max(texts, key=len))["symbols"]
    rows = [(k, t, "en", "large") for k, t in enumerate(texts)] + [(1000, odd, "en", "small"), (1001, odd, "xx", "*"), (1002, odd, None, None), (1003, texts[0], "en", "*"), (1004, texts[1], "xx", None), (1005, "too short", "yy", "s")]
    got = {r["doc_id"]: r for r in outliers.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(r["distance2"] is not None for r in got.values())
    assert [got[k]["kept"] for k in range(1000, 1006)] == [False, False, False, True, True, False]
    assert sum(got[k]["kept"] for k in range(n)) >= 0.95 * n


def test_quality_edges(spark):
    docs = edge_docs(spark).withColumns({"m0": F.lit(1), "kept": F.lit("z")})
    out = outliers.quality_verdicts(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert outliers.quality_verdicts(empty_like(docs)).count() == 0


# Token records and packing ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("text", ["Hello's wörld 123 a--b, x.y  z q İstanbul ΣΑΣ", "<|endoftext|> a<|startoftext|>b", "", "...", "a,", "don't. can't,", "é é ́x", "x\x1cy\x85z", "A.b.C,", "日本語 text", "word." * 30])
def test_encoder(tokenizer, text):
    got = np.frombuffer(encoder(TOKENIZER).encode(text.encode()), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> b", "x<|EndOfText|><|STARTOFTEXT|>y <|endoftext|>Z", "É <|ENDOFTEXT|> É<|endoftext|>", "Plain WORDS, <| HERE |>", "H\u0331 T\u0308A W\u030a J\u030c A\u030a"])
def test_encoder_keeps_case_that_matters(tokenizer, text):
    """Special tokens are matched case-sensitively, and letters composed, before lower-casing."""
    got = np.frombuffer(encoder(TOKENIZER).encode(text.encode()), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_beside_the_library(tokenizer):
    """Random texts of letters, composed or not, signs and spaces of several kinds."""
    rng = np.random.default_rng(12)
    alphabet = list("aAbBzZéÉöÖßÿŸĀāİıŉſŒœ×÷ΣσςǅK.'.,!<|>*_-`~@[0192 \n\t\x85\u0301\u0307\u200b日本")
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(1, 14)))
        assert np.frombuffer(encoder(TOKENIZER).encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_other_vocabularies_encode_whole_texts():
    path = TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k")
    other = encoder(path)
    text = "Two  spaces,\n\nlines <|endoftext|> and Words"
    assert not other.wordwise and np.frombuffer(other.encode(text.encode()), "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_records(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in tokenfile.token_digest(docs, TOKENIZER).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_records_are_checked():
    ids = np.array([1, 2, 70000], "<u4").tobytes()
    record = tokenfile.frame(ids, 4)
    assert tokenfile.unframe(record) == ids and tokenfile.unframe(tokenfile.frame(ids[:8], 2)) == ids[:8]
    with pytest.raises(ValueError):
        tokenfile.frame(ids, 2)
    for k in (0, 9, 13, len(record) - 1):
        bad = bytearray(record)
        bad[k] ^= 1
        with pytest.raises(Exception):  # noqa: B017
            tokenfile.unframe(bytes(bad))


def test_token_edges(spark):
    docs = edge_docs(spark).withColumn("file", F.lit("clash"))
    out = tokenfile.token_digest(docs, TOKENIZER).orderBy("start").collect()
    assert len(out) == docs.count()
    at = 0
    for r in out:
        assert r["start"] == at and r["n_tokens"] >= 1
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert tokenfile.token_digest(empty_like(docs), TOKENIZER).count() == 0


def check_packing(rows, expected):
    """Every id in one piece, no gaps, nothing too long."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    pad = sum(0 if (n := sum(r["length"] for r in own)) & (n - 1) == 0 else 2048 - n for own in by_sequence.values())
    for doc, ids in expected.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return pad


def test_packing(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = {r["doc_id"]: np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    assert check_packing(packing.pack_documents(docs, TOKENIZER).collect(), expected) == 0


def test_packing_edges(spark):
    docs = edge_docs(spark).withColumn("offset", F.lit(1))
    out = packing.pack_documents(docs, TOKENIZER)
    assert out.filter("doc_id is null").count() >= 1
    assert sorted(r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect())
    assert packing.pack_documents(empty_like(docs), TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_vector_packing_keeps_limits(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 100, 300)
    loss = (tokens * rng.random(300)).astype(int)
    loss = np.minimum(loss, 60)
    bins = packing.dot_product_pack(tokens, loss, 100, 6, 60)
    assert sorted(i for b in bins for i, _, _ in b) == list(range(300))
    for b in bins:
        assert sum(n for _, _, n in b) <= 100 and len(b) <= 6 and sum(loss[i] for i, _, _ in b) <= 60
    with pytest.raises(ValueError):
        packing.dot_product_pack(np.array([101]), np.array([0]), 100, 6, 60)


def test_limits_that_bind_decide():
    """With loss scarce, heavy and light examples go together; by tokens alone they would not."""
    tokens, loss = np.array([50] * 8), np.array([40] * 4 + [0] * 4)
    bins = packing.dot_product_pack(tokens, loss, 100, 256, 40)
    assert len(bins) == 4 and all(sum(loss[i] for i, _, _ in b) == 40 for b in bins)
    assert len(packing.dot_product_pack(tokens, loss, 1000, 2, 1000)) == 4


def test_pack_examples(spark):
    df = spark.createDataFrame([(i, 10 + i % 50, i % 7, "x") for i in range(500)] + [(None, None, None, None)], "example_id long, n_tokens long, n_loss long, sequence_id string")
    out = packing.pack_examples(df, 64, 4, 12).collect()
    assert len(out) == 501
    sizes = {}
    for r in out:
        sizes.setdefault(r["sequence_id"], []).append(r["example_id"])
    for own in sizes.values():
        assert len(own) <= 4 and sum(10 + i % 50 for i in own if i is not None) <= 64 and sum(i % 7 for i in own if i is not None) <= 12
    assert packing.pack_examples(empty_like(df), 64).count() == 0


def test_dialogues_are_packed_by_their_loss(spark, tokenizer):
    """Every limit holds in every sequence but those of one oversized example, and loss binds somewhere."""
    from quarry.llm import perspectives, queries

    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    views = {(r["conv_id"], r["participant"], r["first_turn"]): r for r in perspectives.perspectives(turns).collect()}
    out = queries.packed_dialogues(spark, SF).collect()
    assert {(r["conv_id"], r["participant"], r["first_turn"]) for r in out} == set(views) and len(out) == len(views)
    sequences = {}
    for r in out:
        view = views[r["conv_id"], r["participant"], r["first_turn"]]
        ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids(view["rendered"])) and r["n_loss"] == sum(len(ids(view["rendered"][m["start"] : m["end"]])) for m in view["mask"])
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: (r["offset"], r["n_tokens"]))
        assert [r["offset"] for r in own] == [sum(x["n_tokens"] for x in own[:k]) for k in range(len(own))]
        if len(own) > 1:
            assert sum(r["n_tokens"] for r in own) <= 4096 and sum(r["n_loss"] for r in own) <= 1536 and len(own) <= 16
    assert any(sum(r["n_loss"] for r in own) > 1300 and sum(r["n_tokens"] for r in own) < 3900 for own in sequences.values())


# Decontamination ---------------------------------------------------------------------------------


def slow_contaminated(docs, items, size=5, threshold=0.8):
    out = set()
    for item, text in items:
        want = decontam.shingle_set(text.encode() if text is not None else None, size)
        for doc, body in docs:
            if want:
                width = len(next(iter(want)))
                own = decontam.shingle_set(body.encode() if body is not None else None, width)
                if len(want & own) >= math.ceil(threshold * len(want) - 1e-9):
                    out.add((doc, item, len(want), len(want & own)))
    return out


def test_decontamination(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = slow_contaminated([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert want
    assert {tuple(r) for r in decontam.contaminated(docs, items).collect()} == want
    assert {tuple(r) for r in decontam.contaminated(docs, items, resident_bytes=0).collect()} == want


def test_candidates_come_by_sketches(spark, monkeypatch):
    """On either path nothing is found but through sketches."""
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {tuple(r) for r in decontam.contaminated(docs, items).collect()}
    sketches = decontam.Sketches([(r["item_id"], r["text"].encode()) for r in items.collect()], 5, 0.8)
    text = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert len({width for width, _, _ in sketches.tables}) >= 1 and len(sketches.tables) > 1
    assert all(sketches.items[k][0] is not None for d, i, _, _ in want for k in sketches.candidates(text[d]))
    monkeypatch.setattr(decontam.Sketches, "candidates", lambda *_: [])
    assert sketches.verified(text[next(iter(want))[0]]) == []


@pytest.mark.parametrize("resident", [0, 1 << 20])
def test_decontamination_edges(spark, resident):
    words = [f"w{i}" for i in range(40)]
    gap = words[:18] + ["changed"] + words[19:]
    docs = [(1, " ".join(words)), (2, "X Y " + " ".join(gap).upper() + " z"), (3, None), (4, ""), (None, " ".join(words[:20])), (5, "a b"), (6, "c a b d"), (6, "c a b d"), (7, " ".join(words * 300))]
    items = [(10, " ".join(words)), (11, None), (12, ""), (13, "a b"), (14, " ".join(words[:20])), (14, " ".join(words[:20])), (None, "d")]
    df, bench = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontam.contaminated(df, bench, resident_bytes=resident).collect()), key=str)
    want = sorted((x for d in docs for i in items for x in slow_contaminated([d], [i])), key=str)
    assert got == want
    clean = decontam.clean_documents(df, bench, resident_bytes=resident)
    left = [d for d in docs if not any(slow_contaminated([d], [i]) for i in items)]
    assert clean.columns == df.columns and sorted((tuple(r)[:2] for r in clean.collect()), key=str) == sorted(left, key=str)
    assert decontam.contaminated(empty_like(df), bench, resident_bytes=resident).count() == 0
    assert decontam.contaminated(df, empty_like(bench), resident_bytes=resident).count() == 0
