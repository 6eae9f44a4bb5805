"""Operators that look across documents, against brute force on small corpora."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from excerptlake.llm import bpe, graph, lines, merkle, near, quotes, repair, simhash, suffixes

from .conftest import corpus


def on_disk(df, tmp_path):
    """Inputs come from files, whose size is known."""
    df.write.parquet(str(tmp_path / "docs"))
    return df.sparkSession.read.parquet(str(tmp_path / "docs"))


def test_grammar_round_trip(monkeypatch):
    monkeypatch.setattr(repair, "MIN_COUNT", 4)
    r = np.random.default_rng(1)
    for _ in range(100):
        ids = r.integers(0, r.integers(2, 40), r.integers(0, 2000)).astype(np.uint32)
        g = repair.compress(ids, 50)
        low, high = sorted(r.integers(0, len(ids) + 1, 2))
        assert (g.decode() == ids).all() and (g.decode(low, high) == ids[low:high]).all()
    assert len(repair.compress(np.tile(np.arange(8), 500).astype(np.uint32), 50).sequence) < 1000


@pytest.mark.parametrize("least", [4, 24])
def test_no_frequent_pair_is_left(monkeypatch, least):
    monkeypatch.setattr(repair, "MIN_COUNT", least)
    r = np.random.default_rng(2)
    shards = [np.full(1 << 19, 7), r.integers(0, 3, 20_000), np.tile(r.integers(0, 50, 700), 40), np.zeros(0), np.zeros(1)]
    for ids in shards:
        g = repair.compress(ids.astype(np.uint32), 50)
        assert (g.decode() == ids).all()
        seen, at, sequence = {}, 0, g.sequence.tolist()
        for k, pair in enumerate(zip(sequence, sequence[1:])):  # no overlap of a pair with itself
            if seen.get(pair, (0, -2))[1] < k - 1:
                seen[pair] = (seen.get(pair, (0, 0))[0] + 1, k)
        assert max((n for n, _ in seen.values()), default=0) < least


def test_token_files(spark, docs, tmp_path):
    path = bpe.vocabulary("word_bpe_49k.json")
    rows = repair.read_shards(repair.write_shards(docs, path, str(tmp_path / "x"))).orderBy("doc_id").collect()
    library, at = Tokenizer.from_file(path), 0
    for (doc_id, text), row in zip(corpus(), rows, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(row) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    shards = repair.write_shards(docs, path, str(tmp_path / "z"))
    wanted = spark.createDataFrame([(5,), (5,), (3,), (999,)], "doc_id long")
    found = {r.doc_id: r.ids for r in repair.read_documents(shards, wanted).collect()}
    texts = dict(corpus())
    assert found == {k: [*library.encode(texts[k] or "", add_special_tokens=False).ids, 1] for k in (3, 5)}
    assert repair.read_shards(repair.write_shards(docs.limit(0), path, str(tmp_path / "y"))).count() == 0


CLAUSE = regex.compile(merkle.CLAUSE)


def brute_tree(text):
    return [tuple(tuple(CLAUSE.findall(p)) for p in s.split("\n")) for s in text.split("\n\n")]


def brute_likeness(a, b):
    """The share of distinct clauses that lie under sections, paragraphs or clauses of both texts."""

    def unlike(x, y):
        sections = [s for s in x if s not in y]
        paragraphs = [p for s in sections for p in s if p not in {p for s in y for p in s}]
        return len({c for p in paragraphs for c in p} - {c for s in y for p in s for c in p})

    x, y = brute_tree(a), brute_tree(b)
    total = sum(len({c for s in t for p in s for c in p}) for t in (x, y))
    return 1 - (unlike(x, y) + unlike(y, x)) / total if total else 1.0


@pytest.mark.parametrize("shards", [1, 5, 700])
def test_edit_fingerprints(docs, shards):
    rows = merkle.edit_fingerprints(docs, shards).orderBy("doc_id").collect()
    pairs = [(i, t or "") for i, t in corpus()]
    for k, ((doc_id, text), row) in enumerate(zip(pairs, rows, strict=True)):
        half, after = len(text) // 2, pairs[(k + 1) % len(pairs)][1]
        edited = text[: len(text) - half] + after[:half]
        assert (row.doc_id, row.n_chars, row.edited_sha256) == (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert row.near_edited == pytest.approx(brute_likeness(text, edited)) and row.near_next == pytest.approx(brute_likeness(text, after))
    by_text = {}
    for (_, text), row in zip(pairs, rows):
        by_text.setdefault(text, set()).add(row.fingerprint)
    assert all(len(f) == 1 for f in by_text.values()) and len(set().union(*by_text.values())) == len(by_text)


def test_edits_without_ids(make_docs):
    """Null and shared ids: an order by a hash of the text, a cycle over all rows; any script has leaves."""
    texts = ["日本語の文章がここにあり続ける" * 20, "", "x" * 500, "a b c. d e f.", "\n\n\n", "日" * 300]
    pairs = [(None, t) for t in texts] + [(7, t) for t in texts] + [(9, "end")]
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)
    order = sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    expected = []
    for k, (doc_id, text) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(brute_likeness(text, edited), 9)))
    for shards in (1, 40):
        got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9)) for r in merkle.edit_fingerprints(make_docs(pairs), shards).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert merkle.edit_fingerprints(make_docs([]), 3).count() == 0


def test_first_difference(spark):
    texts = [("a\n\nb\nc\n\nd", "a\n\nb\nx\n\nd"), ("a", "a"), ("a", "a\n\nb"), ("", "z")]
    df = spark.createDataFrame(texts, "a string, b string")
    prints = [merkle.fingerprint(merkle.tree(F.col(c)), F.col(c)) for c in "ab"]
    got = [r[0] and tuple(r[0]) for r in df.select(merkle.first_difference(*prints)).collect()]
    assert got == [(2, 3), None, (2, 2), (1, 1)]


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_groups(docs):
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(docs).collect()}
    prints = {i: brute_simhash(t) for i, t in corpus()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert got == {i: (prints[i], c) for i, c in classes(prints, near).items()}
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_near_copies(spark, make_docs, tmp_path):
    """All pairs of documents with a Jaccard similarity of 5-word shingles from 0.8 on are in one group."""
    r = random.Random(14)
    word = lambda: f"w{r.randrange(3000)}"
    common = " ".join(f"c{k}" for k in range(9))
    texts = [" ".join(word() for _ in range(r.randint(0, 120))) + " " + common for _ in range(40)] + ["", None, "one two"]
    for _ in range(140):  # copies of copies, edited in up to six places
        words = (r.choice(texts) or "").split()
        for _ in range(r.randint(0, 6)):
            at = r.randint(0, len(words))
            words[at : at + r.randint(0, 1)] = [word()]
        texts.append(" ".join(words))
    pairs = list(enumerate(texts))

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}

    sets = {i: shingles(t) for i, t in pairs}
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    linked = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    far = [(a, b) for a, b in linked if (brute_simhash(texts[a]) ^ brute_simhash(texts[b])).bit_count() > 3]
    assert len(far) > 20
    df = on_disk(make_docs(pairs), tmp_path)
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, df, str(tmp_path)).collect()}
    assert kept == {i for i, c in classes(sets, linked).items() if i == c}
    assert {x.doc_id: x.component_id for x in near.near_groups(df).collect()} == classes(sets, linked)
    assert near.near_groups(make_docs([])).count() == 0


def test_pipeline_finds_near_copies_by_simhash(spark, make_docs, tmp_path, monkeypatch):
    """Without candidates from prefixes, what SimHash links and the exact comparison confirms is one group."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(150)) for _ in range(12)] + ["", "a b"]
    texts += [f"{t} tail" for t in texts[:8]] + [t.upper() + "  " for t in texts[4:]] + ["head " + t for t in texts[2:6]]
    pairs = list(enumerate(texts))
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in pairs for w in [t.lower().split()]}
    near_by = lambda a, b: (brute_simhash(texts[a]) ^ brute_simhash(texts[b])).bit_count() <= 3
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    linked = [(a, b) for a, _ in pairs for b, _ in pairs if a < b and alike(shingles[a], shingles[b]) and near_by(a, b)]
    assert any(brute_simhash(texts[a]) != brute_simhash(texts[b]) for a, b in linked)
    made = near.prefixes
    monkeypatch.setattr(near, "prefixes", lambda docs, last: made(docs, last).filter("false"))
    kept = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, on_disk(make_docs(pairs), tmp_path), str(tmp_path)).collect()}
    assert kept == {i for i, c in classes(shingles, linked).items() if i == c}


def test_covering_misses_no_link(spark):
    r = random.Random(4)
    values = {0}
    for _ in range(15):
        seed = r.getrandbits(64)
        values |= {seed ^ sum(1 << b for b in r.sample(range(64), k)) for k in (0, 1, 2, 3, 3, 4)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    found = {tuple(x) for x in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_components(spark, tmp_path):
    r = random.Random(6)
    edges = sorted({tuple(sorted(r.sample(range(200), 2))) for _ in range(130)}) + [(i, i + 1) for i in range(300, 360)]
    df = spark.createDataFrame(edges, "src long, dst long")
    found = {x.node: x.root for x in graph.connected_components(df, str(tmp_path)).collect()}
    nodes = {x for e in edges for x in e}
    assert found == {n: c for n, c in classes(nodes, edges).items()}
    assert graph.connected_components(df.limit(0), str(tmp_path / "none")).count() == 0


def test_no_join_of_op6_is_broadcast(spark, docs, tmp_path):
    """Nodes, links and minima grow with the input; a broadcast of them fills the driver."""
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (2,)], "fp long")
    for df in (simhash.near_groups(docs), simhash.links(nodes), graph._large_star(edges), graph._small_star(edges)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def brute_lines(pairs):
    seen, out = set(), {}
    for doc_id, text in pairs:
        if text is None:
            out[doc_id] = None
            continue
        raw = text.encode()
        chunks = {a: c for a, _, c in lines.candidates(raw)}
        parts, keep = raw.split(b"\n"), []
        for a, b in lines.chunk_bounds(parts):
            if a in chunks and chunks[a] in seen:
                continue
            seen.add(chunks.get(a))
            keep += parts[a:b]
        out[doc_id] = b"\n".join(keep).decode()
    return out


def test_line_dedup(docs):
    rows = lines.dedup_lines(docs).collect()
    assert {r.doc_id: r.text for r in rows} == brute_lines(corpus())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.lang == "en" for r in rows)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_one_line_passages(make_docs):
    """A line of 50 words that occurred before goes, whatever stands around it; one of 49 stays."""
    r = random.Random(12)
    passages = [" ".join(f"p{k}w{j}" for j in range(n)) for k, n in enumerate([50, 51, 80, 300, 49])]
    pairs = []
    for i in range(40):
        parts = [f"fresh {i} {j} {r.random()}" for j in range(r.randint(0, 5))]
        for x in r.sample(passages, r.randint(0, 2)):  # never side by side
            parts += [x, f"fresh {i} {r.random()}"]
        if len(parts) > 1 and r.random() < 0.5:
            parts.pop()
        pairs.append((i, "\n".join(parts)))
    seen, expected = set(), {}
    for i, text in pairs:
        keep = []
        for line in text.split("\n"):
            if not (len(line.split()) >= 50 and line in seen):
                keep.append(line)
            seen.add(line)
        expected[i] = "\n".join(keep)
    assert {x.doc_id: x.text for x in lines.dedup_lines(make_docs(pairs)).collect()} == expected


def brute_passages(pairs):
    """Lines within any run of 50 words or more that occurred before, not overlapping; all runs are tried."""
    seen, out = {}, {}
    for i, text in pairs:
        own, gone = text.split("\n"), set()
        runs = [(a, b) for a in range(len(own)) for b in range(a + 1, len(own) + 1)]
        for a, b in sorted(runs, key=lambda x: x[1]):
            run = tuple(own[a:b])
            if len(" ".join(run).split()) >= 50:
                doc, at = seen.setdefault(run, (i, a))
                if doc < i or at + b - a <= a:
                    gone |= set(range(a, b))
        out[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    return out


def test_passages(make_docs):
    """Repeats of several lines go as a whole, without regard to chunks; the data has no shorter ones of two lines."""
    r = random.Random(13)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    wide = [[line(r.randint(26, 40)) for _ in range(r.randint(2, 8))] for _ in range(8)]  # any two lines are a passage
    narrow = [[line(5) for _ in range(14)] for _ in range(4)]
    pairs = [(0, "\n".join([line(30)] * 9))]
    for i in range(1, 70):
        parts = [line(r.randint(1, 20)) for _ in range(r.randint(0, 3))]
        for _ in range(r.randint(0, 3)):
            if r.random() < 0.6:
                p = r.choice(wide)
                parts += p[r.randint(0, len(p) - 2) :][: r.randint(2, 8)]
            else:
                parts += r.choice(narrow)[r.randint(0, 2) :][: r.randint(10, 14)]
            parts += [line(r.randint(1, 20)) for _ in range(r.randint(1, 2))]
        pairs.append((i, "\n".join(parts)))
    expected = brute_passages(pairs)
    assert sum(expected[i] != t for i, t in pairs) > 30
    assert {x.doc_id: x.text for x in lines.dedup_lines(make_docs(pairs)).collect()} == expected


def test_chunks_resist_shifts():
    r = random.Random(8)
    passage = [f"line {r.random()}".encode() for _ in range(40)]
    cut = lambda before: {tuple((before + passage)[a:b]) for a, b in lines.chunk_bounds(before + passage)}
    assert len(cut([]) & cut([b"other", b"lines", b"first"])) >= 8


def brute_repeats(pairs, length=suffixes.LENGTH):
    first, out = {}, set()
    key = lambda i: -(1 << 70) if i is None else i
    for doc_id, text in pairs:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            first[s] = min(first.get(s, 1 << 70), key(doc_id))
    for doc_id, text in pairs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < key(doc_id):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.add((doc_id, len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone) if not g)))
    return out


@pytest.mark.parametrize("case", ["corpus", "fragments", "same_ids", "hot", "blocks", "runs"])
def test_long_repeats(make_docs, tmp_path, monkeypatch, case):
    r = random.Random(9)
    bits = ["".join(r.choice("ab ") for _ in range(r.randint(5, 90))) for _ in range(30)]
    pairs = corpus(3, 40)
    if case != "corpus":
        monkeypatch.setattr(suffixes, "BATCH", 64)
        monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2000)
        pairs = [(r.randint(0, 50) if case == "same_ids" else i, "é".join(r.choice(bits) for _ in range(r.randint(0, 6)))) for i in range(70)]
        pairs.append((None, pairs[5][1]))
    if case == "hot":  # every other anchor gram; units of a few documents
        grams = np.unique(np.concatenate([g for _, t in pairs for g, _, _ in suffixes.segments(t.encode())]))[::2]
        monkeypatch.setattr(suffixes, "hot_groups", lambda docs, size: grams)
        monkeypatch.setattr(suffixes, "UNIT_BYTES", 700)
    if case == "blocks":
        monkeypatch.setattr(suffixes, "BLOCK", 40)
        texts = [t.encode() for _, t in pairs]
        whole = [[(raw[a : a + n + suffixes.LENGTH - 1]) for _, f, c in suffixes.segments(raw) for a, n in zip(f.tolist(), c.tolist())] for raw in texts]
        assert all(sum(len(x) - suffixes.LENGTH + 1 for x in w) == max(0, len(t) - suffixes.LENGTH + 1) for w, t in zip(whole, texts))
    if case == "runs":  # runs of a letter and of a period, in copies of several lengths
        pairs = [(i, r.choice(["z" * r.randint(40, 400), "xy" * r.randint(20, 90), "abc" * 30 + "z" * 70]) + bits[i % 5]) for i in range(40)]
    df = on_disk(make_docs(pairs), tmp_path)
    assert {tuple(x) for x in suffixes.remove_repeats(df).withColumn("kept", F.col("kept").cast("binary")).collect()} == brute_repeats(pairs)


def test_a_hot_key_reaches_its_bucket_once_a_unit():
    dealer = suffixes.Dealer(7)
    for doc in range(1000):
        one = np.ones(1, np.int64)
        dealer.put(one * 3, groups=one.astype(np.uint32), keys=one.astype(np.uint64), docs=one * doc, rids=one * 0, firsts=one * 5, sizes=one * 2)
    rows = pa.Table.from_batches(dealer.flush()).to_pylist()
    assert {r["bucket"] >= 0: len(r["docs"]) // 8 for r in rows} == {True: 1, False: 999}


def test_hot_groups(make_docs):
    common = "the same passage of more than fifty bytes in all of them, word by word"
    docs = make_docs([(i, f"{i * 7919:x} " * 9 + common) for i in range(200)])
    grams = {int(g) for x, _, _ in suffixes.segments(common.encode()) for g in x}
    assert grams & {int(g) for g in suffixes.hot_groups(docs, 1000)} and len(suffixes.hot_groups(docs.limit(0), 0)) == 0


def test_no_rows_no_repeats(make_docs):
    assert suffixes.remove_repeats(make_docs([])).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there\nhow are you?"), (1, 1, "assistant", "> Hello there\n> how are you?\nFine."),
        (1, 2, "user", "On Monday X wrote:\n> > Hello there\n> Fine.\nGreat"), (1, 3, "user", "> nothing like it\nok"),
        (1, 700, "a", "> hello   THERE\nlate"), (2, 0, "user", "> Hello there\nx"), (None, 1, "u", "> a"), (1, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.n_quotes, r.n_linked, r.text) for r in quotes.link_quotes(df).collect()}
    assert found == {
        (1, 0): (None, 0, 0, 0, rows[0][3]), (1, 1): (0, 0, 1, 1, "Fine."), (1, 2): (1, 0, 2, 2, "Great"), (1, 3): (None, 3, 1, 0, rows[3][3]),
        (1, 700): (0, 0, 1, 1, "late"), (2, 0): (None, 0, 1, 0, rows[5][3]), (None, 1): (None, 1, 1, 0, "> a"), (1, None): (None, None, 0, 0, ""),
    }
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_unlinked_passages_stay(spark):
    """Code, patches and quotes of what nobody said are no quotations; linked ones beside them go."""
    repl = "look:\n>>> print(1)\n> said before\n1\n> not said\nok"
    rows = [(1, 0, "u", "said before"), (1, 1, "u", repl), (1, 1, "u", "> other\n> said before")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted(r.text for r in quotes.link_quotes(df).collect())
    assert found == sorted(["said before", "look:\n>>> print(1)\n1\n> not said\nok", ""])


def test_planted_quotes(spark):
    """Each quotation of an earlier turn, re-wrapped, in other case and at any level, is linked."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, parents = [], {}
    for conv in range(20):
        said = []
        for turn in range(30):
            own, text = " ".join(word() for _ in range(r.randint(4, 20))), []
            parents[conv, turn] = None
            if said and r.random() < 0.5:
                k = r.randrange(len(said))
                parents[conv, turn] = k
                mark = "> " if r.random() < 0.5 else ">"
                words = said[k].upper().split() if r.random() < 0.3 else said[k].split()
                cut = r.randint(1, len(words))
                text = [mark + " ".join(words[:cut])] + [mark + " ".join(words[cut:])] * (cut < len(words))
            rows.append((conv, turn, "u", "\n".join([*text, own])))
            said.append(own)
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(x.conv_id, x.turn): x.parent_turn for x in found} == parents
    assert all(">" not in x.text for x in found)


def test_long_thread(spark):
    """Quotes over many blocks of turns link to the latest turn that has the line, as a scan does."""
    r = random.Random(11)
    rows, last, expected = [], {}, {}
    for turn in range(1500):
        said, quoted = f"line {r.randrange(40)}", f"line {r.randrange(40)}"
        rows.append((1, turn, "u", f"> {quoted}\n{said}"))
        expected[turn] = last.get(quoted)
        last[said] = turn
    found = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {x.turn: x.parent_turn for x in found} == expected
    starts = {}
    for turn in range(1500):
        starts[turn] = starts[expected[turn]] if expected[turn] is not None else turn
    assert {x.turn: x.thread_turn for x in found} == starts
