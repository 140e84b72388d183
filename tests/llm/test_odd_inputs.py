"""Pairs that only mean something together, long runs of white space, deep nesting, odd letters, clashing names."""

import time
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from .test_llm_operators import brute_hits, rows_of


def planted_pairs(others, seed=1, n=6000):
    """Documents of 20 other words; 1+2 and 3+4 are toxic, 1+3 and 2+4 clean, each alone toxic in half of its documents."""
    rng = np.random.default_rng(seed)
    terms, labels, paired = [], [], []
    for _ in range(n):
        kind = rng.integers(0, 10)
        own = ((1, 2), (3, 4), (1, 3), (2, 4))[kind] if kind < 4 else (kind - 3,) if kind < 8 else ()
        terms.append(np.array([*own, *np.unique(rng.integers(10, 10 + others, 20))], np.int32))
        labels.append(float(kind < 2 if kind < 4 else rng.integers(0, 2)))
        paired.append(kind < 4)
    return terms, np.array(labels), np.array(paired)


@pytest.mark.parametrize("others", [200, 5000])
def test_pairs_without_a_single_signal_are_learned(others):
    from trialweave.llm.toxicity import fit_machine

    terms, labels, paired = planted_pairs(others)
    model = fit_machine(terms[:4000], labels[:4000])
    right = (model.score(terms[4000:]) >= 0.5) == labels[4000:]
    assert right[paired[4000:]].mean() >= 0.95
    assert len(model.buckets) < 20  # noise terms get no factor


def test_scores_equal_the_sum_over_all_pairs():
    from trialweave.llm.toxicity import Machine

    rng = np.random.default_rng(4)
    model = Machine(-0.3, np.arange(5, 65, 2), rng.normal(size=30), rng.normal(0, 0.4, (30, 4)))
    terms = [np.unique(rng.integers(0, 70, rng.integers(0, 40))) for _ in range(50)]
    for t, got in zip(terms, model.score(terms), strict=True):
        at = [int((x - 5) // 2) for x in t if x in model.buckets]
        raw = model.bias + model.weights[at].sum() + sum(model.factors[i] @ model.factors[j] for i, j in combinations(at, 2))
        assert got == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-12)


@pytest.mark.parametrize("blank", [" ", "\t", "\n"])
def test_long_blanks_keep_the_ids_of_the_tokenizer(spark, blank):
    from trialweave.llm.packing import pack_documents, text_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = text_tokens(path)
    for n in (99_999, 100_000, 1_000_000):
        text = "ab" + blank * n + "c d"
        assert tokens(text).tolist() == tokens.whole.encode(text, add_special_tokens=False).ids
    text = blank * 10_000_000 + "a"
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    pieces = pack_documents(docs, path, with_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of"))
    got = {r["doc_id"]: (r["n"], r["of"]) for r in rows_of(pieces)}
    assert got[1][0] == got[1][1] == len(tokens.whole.encode(text, add_special_tokens=False).ids) + 1


@pytest.mark.parametrize("tag", ["div", "ul", "b", "form", "li", "td"])
def test_deep_pages_take_linear_time(tag):
    from trialweave.llm.html_text import container_scores, main_text, page_blocks

    start = time.time()
    page = page_blocks(f"<{tag}>word " * 20_000)
    container_scores(page)
    text = main_text(page, None)
    assert (tag == "form" or text.count("word") > 19_990) and time.time() - start < 5


def test_embedded_parts_keep_the_block_whole():
    from trialweave.llm.html_text import main_text, page_blocks

    text = lambda source: main_text(page_blocks(source), None)
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be given.</p>") == "Let x=1 be given."
    assert text("<p>a <svg><svg><text>no</text></svg>no</svg> b</p><p>c</p>") == "a b\nc"
    assert text("<p>a<object><p>no</p></object> b</p>") == text("<p>a<script>no</script> b</p>") == "a b"
    assert text("<p>a <svg>unclosed</p><p>b</p>") == "a unclosed\nb"


def test_texts_without_a_letter_have_no_language(spark):
    from trialweave.llm.language import identify_language, train_language

    docs = spark.createDataFrame([("the house and the tree " * 3, "en"), ("das Haus und der Baum " * 3, "de")], "text string, lang string")
    model = train_language(docs.unionByName(docs).withColumn("_hash", F.lit("clash")))
    odd = spark.createDataFrame([(t,) for t in ["½ ² ①", "12 _ !", "", None, "́", "²é"]], "text string")
    got = [r[0] for r in odd.select(identify_language(odd, model)["lang"]).collect()]
    assert got[:5] == ["und"] * 5 and got[5] in ("en", "de")


def test_language_votes_equal_a_count_over_all_pairs():
    from trialweave.llm.language import LanguageModel, letter_grams

    rng = np.random.default_rng(2)
    families = [["a", "b", "c"], ["d"], ["e", "f"]]
    pairs = [("#0", "#1"), ("#0", "#2"), ("#1", "#2"), *combinations("abc", 2), ("e", "f")]
    model = LanguageModel(families, pairs, rng.normal(size=(len(pairs), 8193)))
    texts = ["".join(rng.choice(list("abcdefgh "), 40)) for _ in range(60)]

    def winner(names, margin):
        beats = lambda x, y: margin[x, y] > 0 if (x, y) in margin else margin[y, x] <= 0
        lead = lambda x: sum(margin[x, y] if (x, y) in margin else -margin[y, x] for y in names if y != x)
        return max(names, key=lambda x: (sum(beats(x, y) for y in names if y != x), lead(x), x))

    for text, got in zip(texts, model.predict(texts)[0], strict=True):
        v = letter_grams(text)
        margin = {p: float(v @ m[:-1] + m[-1]) for p, m in zip(pairs, model.machines, strict=True)}
        assert got == winner(families[int(winner(["#0", "#1", "#2"], margin)[1:])], margin)


def test_any_column_name_passes_through(spark):
    from trialweave.llm.decontaminate import without_contaminated
    from trialweave.llm.ngram_join import keep_one_of_each
    from trialweave.llm.secret_scan import redact_secrets
    from trialweave.llm.toxicity import Machine, without_toxic

    names = "_w _N _key _met _starts _hits _first _all _cls _class _known _id toxicity redacted cls class_id row size".split()
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text), (2, text), (3, "other words only here"), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, *names) for i, t in rows], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    items = spark.createDataFrame([("q", " ".join(f"word{i}" for i in range(5, 20)))], "item_id string, text string")
    never = Machine(-40.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 4)))
    for out, ids in (
        (without_contaminated(docs, items), [3, 4, 4]), (keep_one_of_each(docs), [1, 3, 4]),
        (without_toxic(docs, never), [1, 2, 3, 4, 4]), (redact_secrets(docs), [1, 2, 3, 4, 4]),
    ):
        assert out.columns == docs.columns
        got = rows_of(out)
        assert sorted(r["doc_id"] for r in got) == ids
        assert all(r[n] == n for r in got for n in names)


def test_joins_without_a_broadcast_give_the_same(spark, monkeypatch):
    from trialweave.llm import common, decontaminate

    wide = lambda df, limit=0: common.sized(df, 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(str, rows_of(decontaminate.contamination_report(docs, items))))
    monkeypatch.setattr(decontaminate, "sized", wide)
    assert sorted(map(str, rows_of(decontaminate.contamination_report(docs, items)))) == want
    first = docs.filter("text is not null").first()
    listed = [(r["item_id"], r["text"]) for r in rows_of(items)]
    assert brute_hits(first["text"], listed)[1] >= 0
