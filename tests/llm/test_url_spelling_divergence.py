"""URL rules, spelling variants and source divergence against brute force, with the odd inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- 11 url filters ---------------------------------------------------------------------------------


def brute_judge(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], ("block" if best[2] else "allow") if best else "allow"


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(5)
    labels = ["org", "com", "a", "bb", "example", "x-y", "É"]
    out = [None, "", "org/", "://", "http://", "HTTP://ORG/", "http://org", "http://org?/", "http://org#/", "a://b://c/", "http://É.ORG/É/",
           "http://.org/", "http://a..org/x", "http://org./", "x\n://org/\n/y", "http://org/" + "p" * 200_000, "http://org:80/", "http://ORGÉ/"]
    for _ in range(400):
        host = ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
        out.append(f"https://{host}/{''.join(rng.choice('ab/') for _ in range(rng.randrange(0, 6)))}{rng.choice(['', '?q=/a', '#/a'])}")
    return out + out[:40]


def test_urls_against_brute_force(spark, urls):
    from trialweave.llm.url_filter import judge_urls

    rng = random.Random(6)
    rules = [("allow", "org", "/"), ("block", "org", "/a"), ("allow", "example.org", ""), ("block", "a", "/a/"), ("block", "a", "/a/"), ("allow", "a", "/a/")]
    for _ in range(300):
        host = ".".join(rng.choice(["org", "com", "a", "bb", "zz"]) for _ in range(rng.randrange(1, 4)))
        rules.append((rng.choice(["allow", "block"]), host, "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(0, 4)))))
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id long, url string, keys long").withColumn("best", F.lit("clash"))
    listed = spark.createDataFrame([*rules, ("block", None, "/"), ("block", "", "/"), (None, "org", "/a/"), ("deny", "org", "/b")], "verdict string, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows_of(judge_urls(pages, listed))}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate(urls)}
    none = judge_urls(pages, listed.limit(0), default="block")
    assert none.count() == len(urls) and none.filter("verdict <> 'block' OR rule IS NOT NULL").count() == 0
    assert judge_urls(pages.limit(0), listed).count() == 0


def test_cascade_is_exact_where_filters_err(spark):
    from trialweave.llm.url_filter import build_cascade

    keys = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id") % 50).alias("host"), F.concat(F.lit("/"), "id").alias("path"), "id")
    listed = keys.filter("id % 3 = 0")
    cascade = build_cascade(listed, lambda: keys.unionByName(keys), 20_000)
    assert len(cascade.levels) > 4  # many false positives to take back
    found = keys.select("id", cascade.lists(F.col("host"), F.col("path")).alias("l"))
    assert found.filter("l <> (id % 3 = 0)").count() == 0
    with pytest.raises(ValueError, match="max_bits"):
        build_cascade(listed, lambda: keys, 20_000, max_bits=1000)


# ---- 12 spelling variants ---------------------------------------------------------------------------


def brute_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(docs, least=5):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    near = {w: [x for x in n if brute_near(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def spelled(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows_of(df)}


def test_spelling_against_brute_force(spark):
    from trialweave.llm.spelling import spelling_variants

    rng = random.Random(8)
    base = ["banana", "cabana", "aaaaaa", "parser", "spread", "straße", "ÉCLAIR", "éclair", "abcdefgh", "x" * 3000, "stressed", "desserts"]
    words = list(base)
    for w in base:
        for _ in range(25):
            i, c = rng.randrange(len(w)), rng.choice("abersté")
            words.append(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))
    chain = ["aabbcc", "aabbcd", "aabbdd", "abbbdd"]  # each 5 times as frequent as the one before
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(260)]
    texts += [" ".join([w] * (5 ** (i + 1))) for i, w in enumerate(chain)]
    texts += ["", None, "a1b2 ... 漢字 ÷×", "Banana-BANANA", "word " * 20_000, "q" * 100_000]
    ids = [rng.choice([None, 7, 2**60 + 1, i]) for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "n", "word") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n string, vector string")
    docs = docs.unionByName(docs.limit(3))
    want = brute_spelling([(r["doc_id"], r["text"]) for r in rows_of(docs)])
    got = spelled(spelling_variants(docs.repartition(7)))
    assert got == want and sum(v[0] is not None for v in want.values()) > 10
    assert want["aabbcc"][1] == "abbbdd"
    assert spelling_variants(docs.limit(0)).count() == 0


def test_spelling_with_salted_keys(spark):
    from trialweave.llm.spelling import near_pairs

    words = sorted({"abcdef"[:i] + c + "abcdef"[i + (k > 0) :] for i in range(6) for c in "abcdefghijklmnopqrstuvwxyzé" for k in (0, 1)})
    table = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = sorted((r["a"], r["b"]) for r in rows_of(near_pairs(table, 6, hot=5)))
    want = sorted((max(a, b, key=len) if len(a) != len(b) else a, min(a, b, key=len) if len(a) != len(b) else b)
                  for i, a in enumerate(words) for b in words[i + 1 :] if brute_near(a, b))
    assert got == want


def joins_of(df):
    df.collect()
    return re.findall(r"(\w+Join) ", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])


def test_spelling_broadcasts_no_signatures(spark):
    from trialweave.llm.common import sized
    from trialweave.llm.spelling import near_pairs, spelling_variants

    # no key is crowded, so Spark drops the join with the shares and takes 20 signatures of a word for one row
    words = ["spread", "spreads", "parser", "parsers", "banana", "bananas"]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    pairs = near_pairs(table, 6)
    assert joins_of(pairs) == ["SortMergeJoin"]
    assert sorted(r["b"] for r in pairs.collect()) == ["banana", "parser", "spread"]
    docs = spark.createDataFrame([(1, "parser " * 25 + "parsers " * 5)], "doc_id long, text string")
    out = spelling_variants(docs)
    assert joins_of(out) == ["SortMergeJoin"]
    assert spelled(out) == {"parser": (None, "parser", 25, 1, None), "parsers": ("parser", "parser", 5, 1, 25)}
    assert joins_of(table.join(sized(table), "word")) == ["BroadcastHashJoin"]
    assert joins_of(table.join(sized(table, 0), "word")) == ["SortMergeJoin"]


def test_spelling_on_the_table(spark):
    from trialweave.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert spelled(QUERIES["op12_spelling_variants"](spark, sf)) == brute_spelling(docs)


# ---- 13 source divergence ---------------------------------------------------------------------------


def brute_divergence(docs, least=10):
    held, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        held[lang].update(set(terms))
        n[lang, source].update(terms)
    kept = {lang: sorted(t for t, d in h.items() if d >= least) for lang, h in held.items()}
    kept = {lang: kept.get(lang, []) for lang, _ in groups}

    def shares(counts, terms):
        total = sum(counts[t] for t in terms)
        return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(terms)) for t in terms}

    p = {g: shares(n[g], kept[g[0]]) for g in groups}
    whole = {lang: shares(sum((n[g] for g in groups if g[0] == lang), Counter()), kept[lang]) for lang in kept}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, source in groups:
        pairs = [(sum(f(p[lang, source][t], p[lang, o][t]) for t in kept[lang]), o) for la, o in groups if la == lang and o != source]
        terms = [(f(p[lang, source][t], whole[lang][t]), t) for t in kept[lang] if n[lang, source][t] and p[lang, source][t] > whole[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def diverged(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in rows_of(df))


def test_divergence_against_brute_force(spark):
    from trialweave.llm.divergence import source_divergence

    rng = random.Random(9)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["É", "éa", "漢", "A\u00a0b"]
    docs = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "", None, "É"])
        docs.append((rng.choice(["", "!"]).join([" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(104)], k=rng.randrange(30))), "  1A "]), lang, source))
    docs += [(None, "xx", "only"), ("", "xx", "other"), ("rare words", "yy", "s"), ("WAK " * 50_000, "en", "long"), ("zz " * 11, "en", "s1")]
    docs += docs[:5]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, n long, term string")
    want = brute_divergence(docs)
    assert diverged(source_divergence(df.repartition(6))) == want
    assert diverged(source_divergence(df, block=7)) == want  # blocks cut the columns
    assert ("xx", "only", "pair", "other", 0, 1) in want
    assert source_divergence(df.limit(0)).count() == 0


def test_shares_of_large_counts_are_exact(spark):
    from trialweave.llm.divergence import share

    rows = [(10**15 + 7, 3 * 10**15 + 1, 12_345), (0, 0, 1), (9 * 10**18, 9 * 10**18 + 5, 3)]
    df = spark.createDataFrame(rows, "n long, total long, kept long").select(share("n", "total", "kept").alias("p"))
    assert sorted(r["p"] for r in rows_of(df)) == sorted(1 + 10**9 * (n + 2) // (t + 2 * k) for n, t, k in rows)
