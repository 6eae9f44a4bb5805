"""Chat formatting by quotation linking.

A message's lines carry quote levels (leading '>' signs, blanks between them allowed). A run of
lines of one level is a passage; a line that announces a quote ("... wrote:") right before one
belongs to it. Passages are normalised (marks off, lower case, single blanks) and hashed whole, by
paragraph and by line; message bodies, the lines of level 0, are hashed the same way. A quoted unit
is joined to the latest earlier turn of its conversation with that unit in its body; a passage is
linked to the turn that explains most of its characters (ties: the latest). A message replies to
the turn its least quoted linked passage came from.

Reply order: thread_turn is the turn where a message's chain of replies began; sorting a
conversation by (thread_turn, turn) puts every reply behind what it answers. The conversation is
built as rows in that order, not gathered, as one conversation may hold any share of all rows.

The latest earlier turn is found in blocks of BLOCK turns and then among the blocks, so that a unit
that is very common in a very long conversation is spread over many tasks.

Defined cases: null text is the empty text; rows with null conv_id or turn link to nothing; rows
with equal conv_id and turn count as one message for links; a passage that no earlier turn holds
stays unlinked and stays in the text (it may be code, a patch or a prompt); a message of linked
quotes only has an empty text;
extra columns are ignored by the query; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import count

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, table, text_or_empty, work_folder

BLOCK = 256
QUOTE = regex.compile(r"(?:[ \t]{0,3}>)+")
ANNOUNCES = regex.compile(r"(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|écrit|escribió)\s*:\s*", regex.IGNORECASE)


def split_levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without marks) of each line."""
    out = []
    for line in text.split("\n"):
        found = QUOTE.match(line)
        out.append((found[0].count(">"), line[found.end() :].removeprefix(" ")) if found else (0, line))
    return out


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]], list[tuple[int | None, str]]]:
    """The body without quotes, the passages as (level, lines), and the text's parts in order: its
    own lines (None) and the lines of each passage (its number) with what announces it."""
    lines = split_levels(text)
    raw = text.split("\n")
    body, passages, parts = [], [], []
    announced = None
    for i, (level, line) in enumerate(lines):
        if level:
            if i and lines[i - 1][0] == level:
                passages[-1][1].append(line)
                parts[-1][1].append(raw[i])
            else:
                passages.append((level, [line]))
                parts.append((len(passages) - 1, [raw[i]] if announced is None else [announced, raw[i]]))
            announced = None
        elif i + 1 < len(lines) and lines[i + 1][0] and ANNOUNCES.fullmatch(line):
            announced = raw[i]
        else:
            body.append(line)
            if parts and parts[-1][0] is None:
                parts[-1][1].append(raw[i])
            else:
                parts.append((None, [raw[i]]))
    return ("\n".join(body).strip("\n") if passages else text), passages, [(p, "\n".join(x)) for p, x in parts]


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def units(lines: list[str]) -> dict[int, int]:
    """Hash and weight (characters) of the whole, its paragraphs and its lines; equal units once."""
    paragraphs: list[list[str]] = [[]]
    for line in map(normal, lines):
        if line:
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    paragraphs = [p for p in paragraphs if p]
    joined = [" ".join(p) for p in paragraphs]
    out = {}
    for unit in [" ".join(joined), *joined, *(x for p in paragraphs for x in p)]:
        if unit:
            out[xxhash.xxh3_64_intdigest(unit) - (1 << 63)] = len(unit)
    return out


PARTS = "array<struct<passage:int,lines:string>>"


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, rid (tells rows of one turn apart), parts, n_quotes, and per message its
    own and its quoted units."""

    def make():
        def step(batch):
            pieces, counts, own, quoted = [], [], [], []
            for text in batch.column(4).to_pylist():
                body, passages, parts = parse(text)
                pieces.append([{"passage": p, "lines": x} for p, x in parts])
                counts.append(len(passages))
                own.append([*units(body.split("\n"))])
                quoted.append(
                    [{"passage": p, "level": level, "unit": u, "weight": w} for p, (level, lines) in enumerate(passages) for u, w in units(lines).items()]
                )
            kind = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("unit", pa.int64()), ("weight", pa.int32())]))
            of = pa.list_(pa.struct([("passage", pa.int32()), ("lines", pa.string())]))
            columns = [*batch.columns[:4], pa.array(pieces, of), pa.array(counts, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(quoted, kind)]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "rid", "parts", "n_quotes", "own", "quoted"])

        return step

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.xxhash64(text_or_empty()).alias("rid"), text_or_empty().alias("text"),
    )
    schema = f"conv_id long, turn long, role string, rid long, parts {PARTS}, n_quotes int, own array<long>, quoted array<struct<passage:int,level:int,unit:long,weight:int>>"
    return map_arrow(rows, make, schema)


def link_passages(said: DataFrame, folder: str) -> DataFrame:
    """conv_id, turn, rid, passage, level, source: the earlier turn each quoted passage came from."""
    quotes = said.filter("n_quotes > 0 and conv_id is not null and turn is not null")
    quotes = quotes.select("conv_id", "turn", "rid", F.explode("quoted").alias("q")).select("conv_id", "turn", "rid", "q.*").distinct()
    quotes = cut(quotes, f"{folder}/quotes")
    wanted = quotes.select("conv_id", "unit").distinct()
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    own = said.select("conv_id", "turn", F.explode("own").alias("unit")).join(wanted, ["conv_id", "unit"], "left_semi")
    own = own.filter("turn is not null").distinct()
    # rows of both kinds by turn; a quoted unit looks for the last own one before its turn
    both = own.select("conv_id", "unit", "turn", block, F.col("turn").alias("here")).unionByName(
        quotes.select("conv_id", "unit", "turn", block, F.lit(None).cast("long").alias("here")).distinct()
    )
    key = ["conv_id", "unit"]
    earlier = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("here").over(earlier)).filter("here is null")
    blocks = both.groupBy(*key, "block").agg(F.max("here").alias("last"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("far", F.max("last").over(before)).select(*key, "block", "far")
    found = near.join(blocks, [*key, "block"]).select(*key, "turn", F.coalesce("near", "far").alias("source"))
    votes = quotes.join(found.filter("source is not null"), [*key, "turn"])
    votes = votes.groupBy("conv_id", "turn", "rid", "passage", "level", "source").agg(F.sum("weight").alias("weight"))
    best = votes.groupBy("conv_id", "turn", "rid", "passage", "level").agg(F.max(F.struct("weight", "source")).alias("best"))
    return cut(best.select("conv_id", "turn", "rid", "passage", "level", F.col("best.source").alias("source")), f"{folder}/links")


def thread_starts(parents: DataFrame, folder: str) -> DataFrame:
    """conv_id, turn, thread_turn of every message that replies, by doubling the pointers."""
    at = parents.select("conv_id", "turn", F.col("parent_turn").alias("up"))
    for k in count():  # a chain of n replies takes log2(n) rounds
        above = at.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"))
        moved = cut(at.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", "up", "higher"), f"{folder}/threads{k}")
        at = moved.select("conv_id", "turn", F.coalesce("higher", "up").alias("up"))
        if moved.filter("higher is not null").isEmpty():
            break
    return at.withColumnRenamed("up", "thread_turn")


def link_quotes(conversations: DataFrame) -> DataFrame:
    """A row per message: text without linked quotes, reply and thread turns, counts, chat format."""
    folder = work_folder(conversations.sparkSession)
    said = cut(messages(conversations), f"{folder}/messages")
    links = link_passages(said, folder)
    reply = links.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_linked"), F.min(F.struct("level", (-F.col("source")).alias("back"))).alias("first")
    )
    reply = reply.select("conv_id", "turn", "n_linked", (-F.col("first.back")).alias("parent_turn"))
    reply = cut(reply, f"{folder}/replies")
    starts = thread_starts(reply.select("conv_id", "turn", "parent_turn"), folder)
    # a row's linked passages, which the row's length bounds, go from its text; the others stay
    gone = links.groupBy("conv_id", "turn", "rid").agg(F.collect_set("passage").alias("gone"))
    out = said.join(reply, ["conv_id", "turn"], "left").join(starts, ["conv_id", "turn"], "left").join(gone, ["conv_id", "turn", "rid"], "left")
    stays = F.filter("parts", lambda p: p["passage"].isNull() | F.col("gone").isNull() | ~F.array_contains("gone", p["passage"]))
    text = F.array_join(F.transform(stays, lambda p: p["lines"]), "\n")
    out = out.withColumn("body", F.when(F.col("gone").isNull(), text).otherwise(F.regexp_replace(text, "^\n+|\n+$", "")))
    role = F.coalesce("role", F.lit("unknown"))
    return out.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.col("n_quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("body").alias("text"), F.concat(F.lit("<|"), role, F.lit("|>\n"), "body", F.lit("\n<|end|>")).alias("formatted"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))
