"""Row-wise operators: secrets, tokens, toxicity, decontamination."""

import random
import re
import time

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from excerptlake.llm import bpe, decontam, repair, secrets, toxicity

from .conftest import corpus

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(["assign", "access", "hex"][k], s, e) for s, k, e in sorted(out)]


def test_secrets_equal_backtracking_search():
    r, scan = random.Random(3), secrets.scanner()
    parts = ["password", "PassWD", "secret", "token", "apikey", "API_key", "=", ":", " ", '"', "AKIA", "IOSF0DNN7EXAMPLE", "deadbeef" * 4, "é", "ſecret", "\n", "Zq9", "tokentoken=", "日"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [x for x in scan.spans(text.encode()) if x[0] in ("assign", "access", "hex")] == base_spans(text)


def test_secret_rows(docs):
    rows = secrets.find_secrets(docs).collect()
    assert len(rows) == docs.count() and all(r.n_assign is not None for r in rows)
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_automaton_agrees_with_re():
    for pattern in ("a(b|cd)*e", "[a-c]{2,3}x?", "(ab?)+c", r"\x61\.b", "[^ab]c"):
        dfa = secrets.determinise([secrets.parse(pattern)], False)
        for n in range(4096):
            text = "".join("abcdex.."[n >> 3 * k & 7] for k in range(4))
            ends = [e for e in range(len(text) + 1) if re.fullmatch(pattern, text[:e])]
            assert secrets.Scanner.reach(dfa, text.encode(), 0, len(text), 1) == (ends[-1] if ends else -1)


ODD = ["", "  a", "a   b", "a\n\n  b", "a  ", "\n \n b", "hi<|endoftext|>there", "a b　 c", "x" * 3000, "don't we'LL 'S", "a \x1c b\x85", "日本語 é é", "<|ENDOFTEXT|> A"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    path = bpe.vocabulary(name)
    texts = ODD + [t or "" for _, t in corpus(1)]
    encoder = bpe.load(path) if name.startswith("byte") else repair.WordEncoder(path)
    ids, bounds = encoder.encode_batch(pa.array(texts))
    expected = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in expected]


SIGNS = ["\u0130", "\u0307", "\u030c", "J", "H\u0331", "\u1e9e", "'", "'S", "'LL", "\u2019", "<|endoftext|>", "<|startoftext|>", "\x05", "\x1b[31m", "\x7f", "\x1c", "\x85", "\xa0", " ", "\n", "\x0b", "e\u0301", "\u65e5\u672c", "\u03a3", "\u00aa", "\u00b5", "\u00d7", "12", "\u00bd", "\u2167", "!", "?!", "\u2026", "word", "\u3000", "\U0001f600", "\ufb01", "\u1100\u1161", "\ufeff", "\u00fc.", "(\u0130)"]


def random_text(r):
    out = []
    for _ in range(r.randint(0, 12)):
        k = r.random()
        if k < 0.5:
            out.append(r.choice(SIGNS))
        elif k < 0.7:
            out.append(chr(r.randint(0, 0x17F)))
        elif k < 0.8:
            out.append(chr(r.choice([r.randint(0x300, 0x36F), r.randint(0x370, 0xD7FF), r.randint(0xE000, 0x1FFFF)])))
        else:
            out.append("".join(r.choice("abcABC' .,") for _ in range(4)))
    return "".join(out)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_random_texts(name):
    """Over all classes of code points, controls and marks too."""
    path, r = bpe.vocabulary(name), random.Random(7)
    encoder = bpe.load(path) if name.startswith("byte") else repair.WordEncoder(path)
    texts = [random_text(r) for _ in range(10_000)]
    library = Tokenizer.from_file(path)
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        ids, bounds = encoder.encode_batch(pa.array(part))
        expected = library.encode_batch(part, add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in expected]


def test_decode_round_trip(docs):
    rows = bpe.encode_decode(docs, bpe.vocabulary("byte_bpe_50k.json")).collect()
    assert all(r.decoded == (r.text or "") for r in rows)
    assert bpe.digests(docs.limit(0), bpe.vocabulary("byte_bpe_50k.json")).count() == 0


def test_merges_by_rank_then_place():
    merges = {(1, 1): (0, 2), (2, 1): (1, 3)}
    assert bpe.merge_pairs([1, 1, 1], merges) == [3] and bpe.merge_pairs([1, 1, 1, 1], merges) == [2, 2]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_lexicon_automaton_equals_distances():
    r = random.Random(2)
    terms = [toxicity.Term(t, 1.0, False) for t in ("idiot", "moron", "worthless", "disgusting", "scum")]
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        word = list(r.choice(terms).text)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(word) + 1)
            word[k : k + r.randint(0, 1)] = r.choice(["", "a", "o", "é"])
        word = "".join(word)
        best = min((distance(word, t.text), k) for k, t in enumerate(terms) if distance(word, t.text) <= t.edits) if any(distance(word, t.text) <= t.edits for t in terms) else None
        got = automaton.match(word)
        assert (got and got[1]) == (best and best[0])
    stem = toxicity.LexiconAutomaton([toxicity.Term("lowei", 1.0, True)])
    assert stem.match("loweischaft") == (0, 0) and stem.match("lowaischaft") is None


def test_quotation_marks():
    inside = toxicity.within_quotes
    assert not inside("don’t be a ", ", it’s bad") and not inside("don't be a ", ", it's bad") and not inside("", "” he said")
    assert inside("he said “you ", "” and") and inside("‘a ", "’ and") and inside('"', '"') and inside("« ", " »") and not inside("“a ", "’s")


def test_automaton_starts_anew(monkeypatch):
    terms = [toxicity.Term(t, 1.0, False) for t in ("worthless", "disgusting", "scummy")]
    words = ["".join(random.Random(k).sample("worthlesdigun", 9)) for k in range(500)] + ["worthlss", "disgustng", "scumy"]
    expected = [toxicity.LexiconAutomaton(terms).match(w) for w in words]
    monkeypatch.setattr(toxicity, "MAX_STATES", 5)
    automaton = toxicity.LexiconAutomaton(terms)
    assert [automaton.match(w) for w in words] == expected and expected[-1] == (2, 1) and len(automaton.states) < 40


def test_toxicity_on_unseen_rows(spark, make_docs):
    r = random.Random(5)
    filler = "der the of and quiet river stone walks under light morning paper".split()
    pairs, labels = [], []
    for i in range(600):
        words = [r.choice(filler) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(30)] = r.choice(["grumblewort", "snarkface", "blightbrain"])
        pairs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = make_docs(pairs + [(None, None), (1000, ""), (1001, "you are a grumblewart, blightbrain")])
    table = spark.createDataFrame(labels + [(0, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table)
    found = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert all((found[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in range(600))
    assert found[1001] >= toxicity.THRESHOLD > found[1000]
    assert toxicity.score(docs, toxicity.fit(docs, table.limit(0))).filter("score <> 0").count() == 0


def best_cost(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_alignment_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(500):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randint(*n))) for n in ((1, 14), (0, 25)))
        cost = best_cost(p, t)
        edits, a, b = decontam.align(p, t, cost)
        assert edits == cost == distance(p, t[a:b]) and (cost == 0 or decontam.align(p, t, cost - 1) is None)


def test_planted_passages(spark, make_docs):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, text(r.randint(8, 60))) for k in range(20)] + [(20, None), (None, "x"), (21, "short")]
    pairs, planted = [(900, None), (901, ""), (902, text(30000))], {}
    for k, item in items[:20]:
        edited = list(item)
        for _ in range(len(item) // 25):
            edited[r.randrange(len(edited))] = r.choice("xyz")
        pairs.append((k, text(80) + " " + "".join(edited) + " " + text(40)))
        planted[k] = k
        pairs.append((100 + k, text(120)))
    found = decontam.find_matches(make_docs(pairs), spark.createDataFrame(items, "item_id long, text string")).collect()
    hits = {x.doc_id: {m.item_id for m in x.matches or []} for x in found}
    assert all(planted[k] in hits[k] for k in planted)
    assert not any(hits[i] for i in hits if i not in planted)
    empty = decontam.find_matches(make_docs(pairs), spark.createDataFrame([], "item_id long, text string"))
    assert empty.filter("size(matches) > 0").count() == 0


def test_all_regions(monkeypatch):
    """The items named are those that a search of every place for every segment finds, dense or not."""
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([9, 20, 64, 100, 119, 120, 121, 180, 300])] + [(20, "a" * 130), (21, "short"), (22, "xyz")]
    index = decontam.Index(items)
    docs = []
    for _ in range(60):
        part = r.choice(items)[1]
        at = r.randint(0, len(part) // 3)
        part = [*part[at : at + r.randint(10, 200)]]
        for _ in range(r.randint(0, 8)):
            part[r.randrange(len(part))] = r.choice(["", "q", "ab"])
        docs.append(text(r.randint(0, 80)) + "".join(part) + text(r.randint(0, 80)) + r.choice(["", "short", "xy", "xyz"]))
    docs += ["a" * 700, "a" * 125 + "b" * 20, "", "abc", "xyz"]

    def brute(doc):
        return {
            item for item, t in items for s in (decontam.segments_of(t.encode()) if len(t) >= decontam.Q else [t.encode()])
            if best_cost(s, doc.encode()) <= max(0, decontam.budget_of(s))
        }

    def found(doc):
        return {x["item_id"] for x in decontam.describe(index, doc.encode())}

    expected = [brute(d) for d in docs]
    assert [found(d) for d in docs] == expected and sum(map(bool, expected)) > 15
    long = "".join(d + text(60) for d in docs)
    whole = found(long)
    for dense, block in ((0, 1 << 20), (1 << 20, 900), (0, 900)):  # windows of dense blocks; many blocks
        monkeypatch.setattr(decontam, "DENSE", dense)
        monkeypatch.setattr(decontam, "BLOCK", block)
        assert [found(d) for d in docs] == expected and found(long) == whole == set().union(*expected)


def test_common_runs_take_no_time():
    r = random.Random(1)
    text = lambda: "".join(r.choice("abcdefgh ") for _ in range(80))
    index = decontam.Index([(k, text() + "a" * 100 + text()) for k in range(40)])
    began = time.perf_counter()
    index.search(b"a" * 8000)
    assert time.perf_counter() - began < 3  # 20 s if each place met each segment
