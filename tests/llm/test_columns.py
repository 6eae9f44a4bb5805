"""Extra columns whose names the operators use themselves."""

import re

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from excerptlake.llm import bpe, decontam, lines, merkle, repair, secrets, simhash, suffixes, toxicity

from .conftest import corpus
from .test_global import classes

CLASHING = "matches ids decoded row places fp component_id range shard guest first_doc n_lines score ranges of part base label anchor k1".split()


def test_clashing_columns(spark, make_docs, tmp_path):
    plain = make_docs(corpus(2, 25))
    wide = plain.select("*", *[F.lit(k).alias(n) for k, n in enumerate(CLASHING)])
    wide.write.parquet(str(tmp_path / "wide"))
    plain.write.parquet(str(tmp_path / "plain"))
    plain, wide = (spark.read.parquet(str(tmp_path / n)) for n in ("plain", "wide"))
    items = spark.createDataFrame([(1, "alpha beta gamma delta foo, bar. baz; qux the of and")], "item_id long, text string")
    model = toxicity.Model([], None)
    path, words = bpe.vocabulary("byte_bpe_50k.json"), bpe.vocabulary("word_bpe_49k.json")
    runs = {
        "secrets": secrets.find_secrets, "bpe": lambda d: bpe.encode_decode(d, path).select("doc_id", "ids", "decoded"),
        "files": lambda d: repair.read_shards(repair.write_shards(d, words, str(tmp_path / f"f{len(d.columns)}"))),
        "merkle": lambda d: merkle.edit_fingerprints(d, 3), "simhash": simhash.near_groups,
        "toxicity": lambda d: toxicity.score(d, model).select("doc_id", "score"),
        "lines": lambda d: lines.dedup_lines(d).select("doc_id", "text", "n_lines"),
        "decontam": lambda d: decontam.find_matches(d, items).select("doc_id", "matches"), "suffixes": suffixes.remove_repeats,
    }
    for name, run in runs.items():
        assert sorted(map(str, run(plain).collect())) == sorted(map(str, run(wide).collect())), name


def test_stages_keep_columns(spark, make_docs, tmp_path):
    """Stages on documents with nulls and copies; labels may be missing, and all rows may go."""
    make_docs(corpus(4, 30)).write.parquet(str(tmp_path / "documents.parquet"))
    for name, schema in (("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def representatives(rows):
    """Places of the rows that stay: the first of each group by doc_id, nulls last, then hash of the text."""
    sets = [shingles(t) for _, t in rows]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if similar(sets[i], sets[j])]
    groups = {}
    for i, root in classes(range(len(rows)), near).items():
        groups.setdefault(root, []).append(i)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, xxhash.xxh64_intdigest((rows[i][1] or "").encode(), 42) ^ 1 << 63)
    return sorted(((rows[i][0], rows[i][1] or "") for i in (min(g, key=order) for g in groups.values())), key=repr)


def test_copies_with_null_and_shared_ids(spark, make_docs):
    t, u, v = "one two three four five six seven", "nothing like the other text at all", "eight nine ten"
    cases = [
        [(1, t), (None, t), (None, u)],
        [(0, t), (1, u), (1, t)],
        [(None, t), (None, t), (None, t + "."), (None, u), (None, None), (None, "")],
        [(3, t), (3, t), (3, u), (3, v), (3, None), (2, None)],
        [(i % 4 or None, " ".join(f"w{(i * k) % 23}" for k in range(30)) + " x" * (i % 3)) for i in range(40)],
    ]
    for rows in cases:
        docs = make_docs(rows)
        kept = corpus_pipeline.drop_near_copies(spark, docs, "")
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr) == representatives(rows)


def test_lines_with_null_and_shared_ids(spark, make_docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a + "\nend"), (1, "start\n" + b), (None, c), (None, "more\n" + c), (None, c + "\n" + a), (2, b), (2, b), (3, "own\n" + a + "\n" + c)]
    got = sorted(((r.doc_id, r.text) for r in lines.dedup_lines(make_docs(rows)).collect()), key=repr)
    # brute force: null first, then doc_id, then the hash; a line of 60 words stays where it stands first
    signed = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63)
    key = lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))
    seen, expected = {}, []
    for row in sorted(rows, key=key):
        out = []
        for line in row[1].split("\n"):
            if len(line.split()) < 50 or seen.setdefault(line, key(row)) == key(row):
                out.append(line)
        expected.append((row[0], "\n".join(out)))
    assert got == sorted(expected, key=repr)


def test_stages_keep_clashing_columns(spark, make_docs, tmp_path):
    make_docs(corpus(4, 20)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    docs = docs.select("*", F.lit(7).alias("N_lines"), F.lit("keep").alias("n_removed_lines"), F.lit(1.5).alias("matches"), F.lit("r").alias("row"))
    docs.write.parquet(str(tmp_path / "wide"))
    docs = spark.read.parquet(str(tmp_path / "wide"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert {(r.N_lines, r.n_removed_lines, r.matches, r.row) for r in out.collect()} == {(7, "keep", 1.5, "r")}, name


def test_pipeline_equals_its_parts(spark, make_docs, tmp_path):
    """run() against brute force of the deduplicating stages, with nothing toxic or contaminated."""
    from .test_global import brute_lines

    pairs = [(i, t) for i, t in corpus(6, 30)]
    make_docs(pairs).write.parquet(str(tmp_path / "documents.parquet"))
    for name, schema in (("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    texts = brute_lines(pairs)
    decode = bpe.load(bpe.vocabulary("byte_bpe_50k.json")).decode
    found = sorted(((r.doc_id, decode(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert found == representatives([*texts.items()])
