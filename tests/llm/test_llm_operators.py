"""Operators of the llm subpackage against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)], DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---- shared helpers -------------------------------------------------------------------------------


def test_words_agree_in_python_and_sql(spark):
    from trialweave.llm.common import split_words, words_of

    texts = ["Ab-cÉ é1 {x}", "İstanbul ÄÖ", "", "a\x00b\x7fc", "日本 語", "A" * 50_000 + " b"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    got = [r[0] for r in df.select(words_of(F.col("text"))).collect()]
    assert got == [words(t) for t in texts] + [[]]
    assert [[w.decode() for w in split_words(t)] for t in [*texts, None]] == got


def test_connected_components(spark):
    from trialweave.llm.common import connected

    rng = random.Random(4)
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 60)] + [(f"{rng.randrange(100, 300)}", f"{rng.randrange(100, 300)}") for _ in range(120)]
    edges += [("900", f"{i}") for i in range(901, 960)] + edges[:3] + [("500", "500")]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {n: top(n) for n in root}
    assert connected(spark.createDataFrame([], "u string, v string")).count() == 0


# ---- 1 toxicity -----------------------------------------------------------------------------------


def test_machine_learns_pairs_that_weights_cannot():
    from trialweave.llm.toxicity import fit_machine

    rng = np.random.default_rng(1)
    terms, labels = [], []
    for _ in range(3000):
        two = rng.permutation(4)[: rng.integers(0, 3)] + 1
        terms.append(np.array([*two, *rng.integers(10, 200, 8)], np.int32))
        labels.append(float(set(two) in ({1, 2}, {3, 4})))  # weights cannot part 1+2 from 1+3
    model = fit_machine(terms[:2000], np.array(labels[:2000]))
    assert ((model.score(terms[2000:]) >= 0.5) == np.array(labels[2000:])).mean() > 0.97


def test_toxicity_held_out(spark):
    from trialweave.llm.queries import QUERIES

    got = QUERIES["op1_toxicity"](spark, SF)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    frame = got.join(labels, "doc_id").filter("held_out").toPandas()
    assert got.count() == docs.count() and set(got.columns) == {"doc_id", "held_out", "score", "predicted"}
    assert frame[frame.toxic == 0].predicted.mean() < 0.03
    assert frame[frame.toxic == 1].predicted.mean() > 0.4  # some labelled documents hold no toxic word
    for row in got.select("doc_id", "held_out").limit(50).collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_toxicity_edges(spark):
    from trialweave.llm.toxicity import score_toxicity, train_toxicity, without_toxic

    bad = [f"you total idiot number {i} here" for i in range(30)]
    docs = documents(spark, [*bad, *[f"a quiet day number {i} here" for i in range(60)], None, "", "you total idiot " * 20_000])
    docs = docs.withColumn("score", F.lit("clash")).withColumn("_y", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(90)] * 2 + [(None, 1), (4, None)], "doc_id long, toxic int")
    model = train_toxicity(docs, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(got) == 93 and all(got[i].predicted == (i < 30) for i in range(90))
    assert got[90].score == got[91].score < 0.5 and got[92].predicted == 1
    assert set(without_toxic(docs, model).columns) == set(docs.columns) and without_toxic(docs, model).count() == 62
    assert score_toxicity(docs.limit(0), model).count() == 0
    none = train_toxicity(docs, labels.limit(0))
    assert {r.predicted for r in score_toxicity(docs, none).collect()} == {0}


# ---- 2 secrets ------------------------------------------------------------------------------------


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secret_base_spans_against_brute_force(spark):
    from trialweave.llm.secret_scan import find_secrets

    rng = random.Random(5)
    parts = ["password", "Token", "secret", "api", "_", "key", "=", ":", " ", '"', "'", "AKIA", "ABCD0123", "0123456789abcdef", "a", "f", "é", "İ", "ß", "akia"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(20_000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in texts:
        assert [s for s in find_secrets(text) if s[0] in ("assign", "access", "hex")] == brute_secrets(text), text


def test_secret_checksums_and_redaction(spark):
    from trialweave.llm.secret_scan import checksum62, find_secrets, redact_secrets, secret_report

    body = "aB3" * 10
    good, wrong = f"ghp_{body}{checksum62(body)}", f"ghp_{body}000000"
    assert [s[0] for s in find_secrets(f"x {good} y")] == ["github"] and find_secrets(f"x {wrong} y") == []
    assert [s[0] for s in find_secrets(f"npm_{body}{checksum62(body)}")] == ["npm"]
    assert [s[0] for s in find_secrets("eyJhbGciOiJub25lIn0.e30.abc")] == ["jwt"] and find_secrets("eyJhbGci.e30.abc") == []
    texts = [f"a é {good}, token = abcdef12.", None, "", "f" * 100_000, "clean", "clean"]
    docs = documents(spark, texts).withColumn("kind", F.lit(1)).withColumn("spans", F.lit("x"))
    got = {r.doc_id: r for r in secret_report(docs).collect()}
    assert got[0].spans == "github:4:44,assign:46:63" and got[0].n_assign == 1
    assert got[0].base_sha256 == hashlib.sha256(b"assign:46:63").hexdigest()
    assert got[1].spans == got[2].spans == got[4].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == "hex:0:100000" and got[3].n_hex == 1
    clean = {r.doc_id: r for r in redact_secrets(docs).collect()}
    assert clean[0].text == "a é <secret>, <secret>" and clean[0].n_chars == len(clean[0].text)
    assert clean[1].text is None and clean[1].n_chars is None and clean[4].text == "clean" and clean[3].text == "<secret>"
    assert secret_report(docs.limit(0)).count() == 0


# ---- 3 chat ---------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    from trialweave.llm.chat import chat_digest, format_chats, parse

    rng = random.Random(6)
    odd = ["<", "|", "\\", "<|", "<|end|>", "<|turn|>", "<|text|>", "<|next|>", "</s>", "<s>", "[INST]", "[/INST]", "[", "\n", "é", "x", "INST]", "/s>", ""]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "a<|text|>b", ""])
            rows.append((conv, turn * rng.choice([1, 50]), role, "".join(rng.choice(odd) for _ in range(rng.randrange(8)))))
    rows += [(99, i, rng.choice(["user", "assistant"]), f"turn {i}") for i in range(500)]
    rows += [(98, 1, None, None), (98, None, "user", "first"), (98, 1, "user", "tie"), (98, 1, "user", "tie"), (None, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    said = format_chats(df, part_turns=16)
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in said.select("conv_id", parse(F.col("formatted")).alias("turns")).collect()}
    assert got == want
    for row in chat_digest(said).collect():
        loss = "".join(t for r, t in want[row.conv_id] if r == "assistant")
        text = "".join(f"{r}\n{t}\n" for r, t in want[row.conv_id])
        assert row.n_turns == len(want[row.conv_id]) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for row in said.collect():
        assert not re.search(r"</?s>|\[/?INST\]", row.formatted) and row.formatted == "".join(s.text for s in row.segments)
    assert format_chats(df.limit(0)).count() == 0


def test_adjacent_turns_of_a_role_share_a_header(spark):
    from trialweave.llm.chat import format_chats

    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert format_chats(df, part_turns=1).first().formatted == "<|turn|>user<|text|>a<|next|>b<|end|><|turn|>assistant<|text|>c<|end|>"


# ---- 4 archives -----------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    from trialweave.llm.warc import digest32, read_archives, write_archives

    pages = [(i, f"https://h.example/{i}?q=a b", f"<p>page {i % 30} é</p>" * (i % 30 + 1)) for i in range(200)]
    pages += [(500, None, None), (501, "u\r\nX: y", ""), (None, "u", "lonely"), (502, "u", "z" * 200_000), (502, "u", "z" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("response", F.lit(1))
    got = read_archives(write_archives(df, archive_bytes=2000)).toPandas()
    assert len(got) == len(pages)
    last = {}
    for i, _, text in pages:
        last[text or ""] = max(last.get(text or "", -1), -1 if i is None else i)
    texts = {i: text or "" for i, _, text in pages}
    for row in got.itertuples():
        key = None if pd.isna(row.page_id) else int(row.page_id)
        payload = texts[key].encode()
        assert row.payload_bytes == len(payload) and row.payload_digest == digest32(payload)
        if key is None or last[texts[key]] == key:
            assert row.record_type == "response" and pd.isna(row.refers_to) and row.payload == payload
        else:
            assert row.record_type == "revisit" and row.refers_to == last[texts[key]]
    few = read_archives(write_archives(df, min_bytes=300)).toPandas()
    assert (few[few.payload_bytes < 300].record_type == "response").all() and (few.record_type == "revisit").any()
    assert write_archives(df.limit(0)).count() == 0 and read_archives(write_archives(df.limit(0))).count() == 0


def test_damaged_archives_are_refused():
    import io

    import zstandard

    from trialweave.llm.warc import decode_record, dictionary_frame, encode_record, read_frames

    records = [encode_record(i, "http://h/", b"some page text %d " % i * 40, None, "1970-01-01T00:00:00Z") for i in range(200)]
    frame, trained = dictionary_frame(records, 4096)
    assert frame and trained
    packer = zstandard.ZstdCompressor(dict_data=trained)
    data = frame + b"".join(map(packer.compress, records))
    assert list(read_frames(io.BytesIO(data), chunk=97)) == records
    for broken in (data[:-5], data + b"junk-junk", frame[: len(frame) // 2]):
        with pytest.raises(ValueError):
            list(read_frames(io.BytesIO(broken)))
    one = records[0]
    for broken in (one[:-1], one.replace(b"WARC/1.1", b"WARC/0.9"), one.replace(b"Content-Length: ", b"Content-Length: 1"), one.replace(b"page text 0", b"page text X"), one.replace(b"WARC-Date", b"WARC-Data")):
        with pytest.raises(ValueError):
            decode_record(broken)


# ---- 5 packing ------------------------------------------------------------------------------------


def test_hilbert_curve_visits_every_cell_by_neighbours():
    from trialweave.llm.packing import hilbert_index

    for bits, many in ((4, 2), (2, 3), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=many)))
        place = hilbert_index(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1).max() == 1


def check_pieces(frame, ids, capacity=1024):
    for doc, group in frame.groupby("doc_id"):
        group, at = group.sort_values("start"), 0
        for r in group.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert zlib.crc32(ids[doc][at : at + r.length].astype("<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[doc])
    padding = 0
    for _, group in frame.groupby("sequence_id"):
        group, at = group.sort_values("offset"), 0
        for r in group.itertuples():
            assert r.offset == at
            at += r.length
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from trialweave.llm.packing import pack_documents, text_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect()]
    texts += [None, "", "a<|endoftext|>b", "naïve 日本語 🎉 ²½ \x1c\x85", "word " * 30_000, "copy", "copy"]
    want = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in enumerate(texts)}
    assert text_tokens(path).fast is not None
    docs = documents(spark, texts).withColumn("length", F.lit("clash"))
    frame = pack_documents(docs, path).toPandas()
    assert set(frame.doc_id) == set(want)
    assert check_pieces(frame, want) <= 1024 * 8
    for r in frame.itertuples():
        assert list(r.ids) == list(want[r.doc_id][r.start : r.start + r.length])
    assert pack_documents(docs.limit(0), path).count() == 0
    null = spark.createDataFrame([(None, "x y"), (None, "x y")], "doc_id long, text string")
    assert pack_documents(null, path).count() >= 2


def test_similar_documents_are_neighbours_on_the_curve():
    from trialweave.llm.packing import hilbert_index, project

    rng = random.Random(3)
    kinds = [[f"{a}{i}" for i in range(40)] for a in ("alpha", "bravo", "tango")]
    texts = [" ".join(rng.choice(k) for _ in range(80)) for k in kinds for _ in range(30)]
    spots = np.stack([project(t) for t in texts])
    cells = ((1 / (1 + np.exp(-1.7 * spots))) * 65535).astype(np.int64)
    kind = np.repeat(np.arange(3), 30)[np.argsort(hilbert_index(cells))]
    assert (kind[1:] == kind[:-1]).mean() > 0.8


# ---- 6 decontamination ----------------------------------------------------------------------------


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item, content in items:
        v = words(content)
        size = min(10, len(v))
        for k in range(len(v) - size + 1 if v else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == v[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add(item)
    return len(w), len(hit), sorted(str(i) for i in found if i is not None)


def test_decontamination_against_brute_force(spark):
    from trialweave.llm.decontaminate import contamination_report, without_contaminated

    rng = random.Random(8)
    few = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, items[3][1]), (3, items[3][1]), (None, "only nulls know these ten words in this very order"), (100, "É é Zz aa")]
    texts = [" ".join(rng.choice(few) for _ in range(rng.choice([0, 3, 30, 200]))) for _ in range(30)]
    texts += [None, "", "x " + items[5][1].upper() + " y", "ONLY nulls know, these ten words in this very order", "É é zz AA", "é é zz aa", "w1 " * 20_000, "dup", "dup"]
    docs = documents(spark, texts).withColumn("window", F.lit(1)).withColumn("h", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("gram", F.lit(2))
    got = {r.doc_id: r for r in contamination_report(docs, bench).collect()}
    clean = {r.doc_id for r in without_contaminated(docs, bench).collect()}
    for i, text in enumerate(texts):
        n, hit, found = brute_hits(text, items)
        row = got[i]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (n, hit, len(found), hit > 0), (i, text)
        assert row.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (i in clean) == (hit == 0)
    assert contamination_report(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in contamination_report(docs, bench.limit(0)).collect()} == {0}


# ---- 7 n-gram join --------------------------------------------------------------------------------


def brute_links(texts):
    sets = []
    for text in texts:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [set() for _ in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        group[i] = min(seen)
    return group, [len(x) for x in links]


@pytest.mark.parametrize("block_rows", [512, 7])
def test_ngram_join_against_brute_force(spark, block_rows):
    from trialweave.llm.ngram_join import keep_one_of_each, ngram_jaccard_join

    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 120]))] for _ in range(25)]
    texts = []
    for kind, b in enumerate(base):
        for _ in range(40 if kind == 0 else rng.randrange(1, 6)):
            w = list(b)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [texts[0]] * 5 + [texts[0].upper(), None, "", " - ", None, "one two", "One, two!", "w " * 20_000]
    rng.shuffle(texts)
    docs = documents(spark, texts).withColumn("cls", F.lit(1)).withColumn("links", F.lit("x"))
    got = {r.doc_id: r for r in ngram_jaccard_join(docs, block_rows=block_rows).collect()}
    group, links = brute_links(texts)
    assert [got[i].n_links for i in range(len(texts))] == links
    assert [got[i].class_id for i in range(len(texts))] == group
    kept = keep_one_of_each(docs.unionByName(docs), block_rows=block_rows)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))
    assert ngram_jaccard_join(docs.limit(0)).count() == 0 and keep_one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_without_words_and_under_one_id(spark):
    from trialweave.llm.ngram_join import keep_one_of_each

    long = "one two three four five six seven eight nine ten " * 4
    rows = [(5, "!!! ???"), (3, "!!! ???"), (9, "!!! ???"), (4, "..."), (6, ""), (7, None), (7, None), (8, ""), (3, "...")]
    rows += [(1, long + "a"), (1, long + "b"), (2, long + "a"), (None, "- -"), (None, "- -"), (11, "lone words")]
    got = rows_of(keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")))
    got = sorted(((r["doc_id"], r["text"]) if isinstance(r, dict) else tuple(r) for r in got), key=str)
    first = min((long + "a", long + "b"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got == sorted([(3, "!!! ???"), (3, "..."), (6, ""), (7, None), (8, ""), (1, first), (None, "- -"), (11, "lone words")], key=str)


def test_posterior_bound():
    from trialweave.llm.ngram_join import least_matches

    least = least_matches(0.8, 1e-7)
    assert least == sorted(least) and len(least) == 8
    for n, m in zip(range(16, 129, 16), least, strict=True):  # a pair at the threshold is hardly ever dropped
        assert sum(math.comb(n, j) * 0.8**j * 0.2 ** (n - j) for j in range(m)) < 1e-6


# ---- 8 nearest neighbours -------------------------------------------------------------------------


def exact_nearest(frame, k=20):
    out = {}
    space, ids = np.stack(frame.embedding).astype(float), frame.vec_id.to_numpy()
    for q in np.flatnonzero(ids % 20 == 0):
        score = space @ space[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[ids[q]] = list(ids[order])
    return out


def test_permutation_search_recall(spark):
    from trialweave.llm.queries import QUERIES

    for sf in ("sf0.01", "sf0.1"):
        frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
        got = QUERIES["op8_nearest_neighbours"](spark, f"/root/testdata/{sf}").toPandas()
        want = exact_nearest(frame)
        assert (got.groupby("query_id").size() == [len(want[q]) for q in sorted(want)]).all()
        hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
        assert hits / sum(map(len, want.values())) >= 0.9
        space = dict(zip(frame.vec_id, frame.embedding, strict=True))
        for r in got.head(200).itertuples():
            assert abs(r.score - np.dot(space[r.query_id].astype(float), space[r.vec_id].astype(float))) < 1e-12


def test_permutation_search_edges(spark):
    from trialweave.llm.permutation_index import permutation_search

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 7)], 0) for i in range(60)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0) for i in range(41)]
    rows += [(200, None, 0), (220, [0.0] * 6, 0), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (260, [float("nan")] + [1.0] * 5, 0), (280, [float("inf")] + [1.0] * 5, 0), (300, [1.0, 2.0], 0), (None, [1.0] * 6, 0), (20, rows[20][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    asks = F.col("vec_id") % 20 == 0
    got = permutation_search(df, asks, block_rows=16, query_rows=3).toPandas()
    frame = pd.DataFrame([r for r in rows[:101]], columns=["vec_id", "embedding", "x"])
    want = exact_nearest(frame)
    assert set(got.query_id) == set(want)
    hit = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id")) / sum(map(len, want.values()))
    assert hit >= 0.9 and (got.groupby("query_id")["rank"].max() == 20).all() and not got.duplicated(["query_id", "vec_id"]).any()
    assert list(got[got.query_id == 100].sort_values("rank").vec_id)[-20:] != []
    few = permutation_search(df.filter("vec_id < 9"), asks).toPandas()
    assert sorted(few.vec_id) == list(range(1, 9))
    assert permutation_search(df.limit(0), asks).count() == 0


def test_permutation_search_repeated_ids(spark):
    from trialweave.llm.permutation_index import permutation_search

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [(7, [float(x) for x in 1.2 * np.asarray(rows[20][1]) + rng.normal(size=6) / 50]) for _ in range(30)]
    df = spark.createDataFrame(rows * 3, "vec_id long, embedding array<double>").repartition(5)
    for block_rows, limit in ((4096, 0.84), (40, 0.84), (4096, 1.0), (40, 1.0)):  # at 1.0 all rows are scored exactly
        got = permutation_search(df, F.col("vec_id") % 20 == 0, block_rows=block_rows, limit=limit).toPandas()
        assert (got.groupby("query_id").size() == 20).all() and not got.duplicated(["query_id", "vec_id"]).any()
        assert (got.groupby("query_id")["rank"].max() == 20).all() and got.query_id.nunique() == 10
        hits = 0
        for query, group in got.groupby("query_id"):
            best = {}
            for i, v in rows:
                if i != query:
                    best[i] = max(best.get(i, -np.inf), float(np.dot(rows[query][1], v)))
            want = sorted(best, key=lambda i: (-best[i], i))[:20]
            hits += len(set(want) & set(group.vec_id))
            if limit == 1:
                group = group.sort_values("rank")
                assert list(group.vec_id) == want and np.allclose(group.score, [best[i] for i in want])
        assert hits >= 180


# ---- 9 HTML ---------------------------------------------------------------------------------------


def test_main_text_of_the_pages_table(spark):
    import html as entities

    from trialweave.llm.queries import QUERIES

    got = {r.page_id: r for r in QUERIES["op9_html_extraction"](spark, SF).collect()}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[page.page_id].text == "\n".join(b for b in blocks if b) and got[page.page_id].n_chars == len(got[page.page_id].text)


def test_main_text_by_host_consensus(spark):
    from trialweave.llm.html_text import extract_main_text

    page = (
        "<html><head><title>T</title><style>p{{}}</style></head><body><div class='top menu3'><ul><li><a href='/'>Home</a></ul></div>"
        "<div class='c17 wrap'><h2>Title {0}</h2><p>Some &lt;long&gt; prose&nbsp;here {0}\n of the\tstory<p>Second <b>bold paragraph {0}"
        "<form><input value=x>Sign up</form><script>if (a<b) '</p>'</script><ul><li>point one<li>point two</ul></div>"
        "<div class='box9'><p>{1}</p></div><div id='comments'><p>Reader says hello, at length, {0} and again and again</p></div><footer>&copy; all</footer>"
    )
    rows = [(i, f"https://Site.example:80/{i}", page.format(i, "short")) for i in range(12)]
    rows.append((50, "https://site.example/odd", page.format(50, "a very long box " * 30)))
    rows += [(60, None, None), (61, "x", ""), (62, None, "just text & more"), (63, "https://other.example", "<p>alone<!-- c --></p>"), (64, "https://site.example/e", "<nav>menu</nav>")]
    rows += [(65, "https://big.example", "<article>" + "<p>para graph</p>" * 20_000 + "</article>"), (66, "https://bad.example", "<div <p a='>x\" 1 < 2 </div>y<a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("host", F.lit("h"))
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    body = "Title {0}\nSome <long> prose here {0} of the story\nSecond bold paragraph {0}\npoint one\npoint two"
    for i in [*range(12), 50]:
        assert got[i] == body.format(i)
    assert got[60] == got[61] == got[64] == "" and got[62] == "just text & more" and got[63] == "alone"
    assert got[65].count("\n") == 19_999 and got[66] is not None
    assert extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", [
    '<div style="overflow: hidden">', '<div title="A hidden gem">', "<div aria-label='hidden'>", "<div data-x=' hidden '>",
    '<div class="content no-sidebar">', '<div class="post has-comments">', '<div class="layout-sidebar-right">',
    "<form action=/x>", '<div class="sidebar">', '<header class="page">', "<div id=post-with-header>",
])
def test_main_text_survives_its_wrapper(wrapper):
    from trialweave.llm.html_text import main_text, page_blocks

    prose = "".join(f"<p>Long prose of the story, part {i}, with enough words to be the page.</p>" for i in range(5))
    tail = "<div class='comments'><p>Short reply</p></div><div class='cookie-banner'><p>Accept</p></div><p hidden>never shown</p>"
    close = f"</{re.match('<([a-z]+)', wrapper)[1]}>"
    want = [f"Long prose of the story, part {i}, with enough words to be the page." for i in range(5)]
    for inside in (prose, f"<article>{prose}</article>", f"<main>{prose}</main>"):
        got = main_text(page_blocks(f"<body><nav><a href=/>Home</a></nav>{wrapper}{inside}{tail}{close}<footer>Imprint</footer></body>"), None)
        assert got.split("\n") == want


def test_comments_longer_than_the_article_stay_out():
    from trialweave.llm.html_text import main_text, page_blocks

    comments = "".join(f"<li class=comment><article class=comment-body><p>Reader {i} says a lot about it.</p></article>" for i in range(40))
    page = f"<main><article><p>The story itself, told in one paragraph that is long enough to be a tenth of all the prose here, and more than that.</p><aside><article>Teaser</article></aside></article></main><ol class=comments>{comments}</ol>"
    assert main_text(page_blocks(page), None).startswith("The story itself") and "Reader" not in main_text(page_blocks(page), None)
    assert "Teaser" not in main_text(page_blocks(page), None)


# ---- 10 language ----------------------------------------------------------------------------------


def test_language_held_out(spark):
    from trialweave.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    frame = QUERIES["op10_language_id"](spark, SF).join(docs, "doc_id").toPandas()
    assert (frame[frame.held_out].lang == frame[frame.held_out].lang_pred).mean() > 0.98
    assert frame.score.between(0, 1).all() and len(frame) == docs.count()


def test_language_families_and_edges(spark):
    from trialweave.llm.language import identify_language, train_language

    rng = random.Random(2)
    parts = {"aa": ["tor", "gul", "min"], "ab": ["tor", "gul", "max"], "ba": ["éri", "ou", "çal"], "bb": ["éri", "ou", "zal"], "cc": ["шту", "бра", "кол"]}
    rows = [(k, " ".join("".join(rng.choice(p) for _ in range(3)) for _ in range(30))) for k, p in parts.items() for _ in range(40)]
    train = spark.createDataFrame(rows[::2] + [(None, "x"), ("aa", None), ("aa", "123")], "lang string, text string")
    model = train_language(train)
    assert sorted(map(sorted, model.families)) == [["aa", "ab"], ["ba", "bb"], ["cc"]]
    test = spark.createDataFrame([*rows[1::2], (None, None), (None, ""), (None, "12 !? 3"), ("aa", "torgulmin " * 20_000)], "lang string, text string").withColumn("score", F.lit("clash"))
    got = test.select("lang", identify_language(test, model).alias("p")).toPandas()
    assert [p["lang"] for p in got.p[-4:]] == ["und", "und", "und", "aa"]
    assert (got.lang[:-4] == [p["lang"] for p in got.p[:-4]]).mean() > 0.95
    nothing = train_language(train.limit(0))
    assert {r.p.lang for r in test.limit(3).select(identify_language(test, nothing).alias("p")).collect()} == {"und"}
    one = train_language(train.filter("lang = 'cc'"))
    assert {r.p.lang for r in test.limit(3).select(identify_language(test, one).alias("p")).collect()} == {"cc"}
    assert test.limit(0).select(identify_language(test, model)).count() == 0


def test_language_of_many_copies_keeps_its_distinct_texts(spark):
    from trialweave.llm import language

    few = spark.range(20_000).select(F.lit("aa").alias("lang"), F.concat(F.lit("torgul "), F.substring(F.lit("abcdefgh"), F.lit(1), (F.col("id") % 4 + 1).cast("int"))).alias("text"))
    mixed = spark.range(20_000).select(F.lit("bb").alias("lang"), F.when(F.col("id") < 19_900, "éri ou").otherwise(F.concat(F.lit("éri "), F.col("id").cast("string"))).alias("text"))
    small = spark.createDataFrame([("cc", f"шту {i}") for i in range(30)] + [(None, "x"), ("dd", "12")], "lang string, text string")
    docs = few.unionByName(mixed).unionByName(small)
    assert sorted(n for f in language.train_language(docs, 50).families for n in f) == ["aa", "bb", "cc"]
    got = {r.lang: r["count"] for r in language.training_texts(docs, 50).groupBy("lang").count().collect()}
    assert got == {"aa": 4, "bb": 50, "cc": 30}
