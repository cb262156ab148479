"""Chat formatting: records of many layouts become canonical turns, then one marked text with a loss mask.

A record's fingerprint is the hash of the sorted paths of its fields that hold a
value, nested ones included (``messages[].role``). Declared mappings list the
paths they need and may have; the fingerprint selects the mapping, which names
the expressions for the turns. No record is inspected outside Spark.

The template marks each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control
strings inside texts are broken by an escape mark after their first character,
and a mark of the text itself is doubled, so texts read back exactly.

Defined cases: a null text is an empty one; a null role is an empty one; a
record that no mapping fits has null turns and the layout ``unknown``; turn rows
with equal numbers are ordered by role and text, null numbers come first, and
repeated rows are repeated turns; rows with a null conversation id are one
conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlake.llm.common import col
from fieldlake.llm.spans import running_sums

TURNS = "array<struct<role:string,text:string>>"
START, END, MARK = "<|im_start|>", "<|im_end|>", "␛"
#: Control strings of common chat templates.
CONTROL = [
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>",
    "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]


# ---- layouts --------------------------------------------------------------

@dataclass(frozen=True)
class Mapping:
    """A layout: the paths it needs, those it may have, and SQL for its turns (an array of role and text)."""

    name: str
    needs: tuple[str, ...]
    turns: str
    may: tuple[str, ...] = field(default=())

    def path_sets(self) -> list[str]:
        more = chain.from_iterable(combinations(self.may, n) for n in range(len(self.may) + 1))
        return [",".join(sorted({*self.needs, *x})) for x in more]


def _turn(role: str, text: str) -> str:
    return f"struct('{role}' AS role, {text} AS text)"


_SHARE_ROLE = "CASE lower(x.`from`) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.`from` END"
MAPPINGS = [
    Mapping("turns", ("turns[].role",), "transform(array_sort(turns), x -> struct(x.role AS role, x.text AS text))", ("turns[].turn", "turns[].text")),
    Mapping("messages", ("messages[].role",), "transform(messages, x -> struct(x.role AS role, x.content AS text))", ("messages[].content",)),
    Mapping("conversations", ("conversations[].from",), f"transform(conversations, x -> struct({_SHARE_ROLE} AS role, x.value AS text))", ("conversations[].value",)),
    Mapping("instruction", ("instruction", "output"), f"array({_turn('user', 'instruction')}, {_turn('assistant', 'output')})", ()),
    Mapping(
        "instruction_input", ("instruction", "input", "output"),
        f"array({_turn('user', 'concat_ws(chr(10), instruction, input)')}, {_turn('assistant', 'output')})",
    ),
    Mapping("prompt_completion", ("prompt", "completion"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'completion')})"),
    Mapping("prompt_response", ("prompt", "response"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'response')})"),
    Mapping("question_answer", ("question", "answer"), f"array({_turn('user', 'question')}, {_turn('assistant', 'answer')})"),
    Mapping(
        "system_prompt", ("system", "prompt", "response"),
        f"array({_turn('system', 'system')}, {_turn('user', 'prompt')}, {_turn('assistant', 'response')})",
    ),
]


def _holds(name: str):
    return lambda x: x.getField(name).isNotNull()


def _paths(kind: T.DataType, at: Column, name: str) -> list[tuple[str, Column]]:
    """Leaf paths below a field, each with the condition that it holds a value."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, at.getField(f.name), f"{name}.{f.name}")]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        fields = [f.name for f in kind.elementType.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType))]
        return [(f"{name}[].{n}", F.coalesce(F.exists(at, _holds(n)), F.lit(False))) for n in fields]
    return [(name, at.isNotNull())]


def with_turns(records: DataFrame, mappings: list[Mapping] | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Add fingerprint, layout and turns. Columns in ``ignore`` (ids and the like) take no part in the fingerprint.

    Only the fields that some mapping knows count, so extra columns change nothing.
    """
    mappings = MAPPINGS if mappings is None else mappings
    known = {p for m in mappings for p in (*m.needs, *m.may)}
    paths = [
        p for f in records.schema.fields if f.name not in ignore for p in _paths(f.dataType, col(f.name), f.name) if p[0] in known
    ]
    present = F.array_sort(F.array_compact(F.array(*(F.when(there, F.lit(p)) for p, there in paths)))) if paths else F.array().cast("array<string>")
    rows = records.drop("fingerprint", "layout", "turns_out").withColumn("fingerprint", F.xxhash64(F.array_join(present, ",")))
    names = {p for p, _ in paths}
    usable = [m for m in mappings if set(m.needs) <= names]
    layout, turns = F.lit("unknown"), F.lit(None).cast(TURNS)
    for m in reversed(usable):
        sets = [s for s in m.path_sets() if set(s.split(",")) <= names]
        fits = F.col("fingerprint").isin([]) if not sets else F.lit(False)
        for s in sets:
            fits = fits | (F.col("fingerprint") == F.xxhash64(F.lit(s)))
        layout = F.when(fits, m.name).otherwise(layout)
        turns = F.when(fits, F.expr(m.turns).cast(TURNS)).otherwise(turns)
    filled = F.transform(turns, lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    return rows.withColumn("layout", layout).withColumn("turns_out", filled)


# ---- template -------------------------------------------------------------

def _pattern() -> str:
    quoted = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
    return "|".join(f"(?<={quoted(s[0])})(?={quoted(s[1:])})" for s in CONTROL)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit(MARK), F.lit(MARK * 2))
    return F.when(text.rlike(r"[<\[" + MARK + "]"), F.regexp_replace(doubled, _pattern(), MARK)).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(MARK)), F.regexp_replace(text, f"{MARK}({MARK}?)", "$1")).otherwise(text)


def formatted(records: DataFrame, turns: str = "turns_out", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add formatted (the text) and loss_mask: turn number, start and end (code points) of each text to learn from."""
    marked = F.transform(F.col(turns), lambda x: F.struct(
        x["role"].alias("role"), F.url_encode(x["role"]).alias("name"), escape(x["text"]).alias("body")
    ))
    rows = records.withColumn("_marked", marked)
    head = lambda x: F.length(x["name"]) + (len(START) + 1)
    whole = lambda x: head(x) + F.length(x["body"]) + (len(END) + 1)
    rows = rows.withColumn("_starts", running_sums(F.transform("_marked", lambda x: whole(x).cast("bigint"))))
    text = F.array_join(F.transform("_marked", lambda x: F.concat(F.lit(START), x["name"], F.lit("\n"), x["body"], F.lit(END + "\n"))), "")
    spans = F.transform("_marked", lambda x, i: F.struct(
        i.cast("int").alias("turn"), (F.get("_starts", i) + head(x)).alias("start"),
        (F.get("_starts", i) + head(x) + F.length(x["body"])).alias("end"), x["role"].isin(*trained).alias("on"),
    ))
    mask = F.transform(F.filter(spans, lambda x: x["on"]), lambda x: x.dropFields("on"))
    return rows.withColumn("formatted", text).withColumn("loss_mask", mask).drop("_marked", "_starts")


def read_back(text: Column) -> Column:
    """The turns of a formatted text, with ``body`` as it stands there."""
    pieces = F.filter(F.split(text, "<\\|im_end\\|>\n"), lambda p: p != "")
    inner = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    return F.transform(pieces, lambda p: F.struct(
        F.url_decode(F.substring_index(inner(p), "\n", 1)).alias("role"),
        F.substring(inner(p), F.instr(inner(p), "\n") + 1, F.length(p)).alias("body"),
    ))


def learned_texts(text: Column, mask: Column) -> Column:
    """The unescaped texts that a mask cuts out of a formatted text, in order; an error where a cut leaves its turn.

    Each cut is made inside the piece of its turn, whose place follows from the text alone, so all take time in
    proportion to the text.
    """
    pieces = F.split(text, "<\\|im_end\\|>\n")
    # structs in one-element arrays, so that the text is split once and not per cut
    sized = F.transform(F.array(F.struct(pieces.alias("p"), mask.alias("m"))), lambda x: F.struct(
        x["p"].alias("p"), x["m"].alias("m"), running_sums(F.transform(x["p"], lambda p: (F.length(p) + (len(END) + 1)).cast("bigint"))).alias("at")
    ))

    def cut(x: Column, m: Column) -> Column:
        piece, at = F.get(x["p"], m["turn"]), F.get(x["at"], m["turn"])
        inside = (m["start"] >= at + len(START)) & (m["start"] <= m["end"]) & (m["end"] <= at + F.length(piece))
        text = F.substring(piece, (m["start"] - at + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
        return F.when(inside, unescape(text)).otherwise(F.raise_error(F.lit("the loss mask leaves its turn")))

    return F.transform(sized, lambda x: F.transform(x["m"], lambda m: cut(x, m)))[0]


def gathered(rows: DataFrame) -> DataFrame:
    """Turn rows (conv_id, turn, role, text) as records: conv_id and turns, in order."""
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_digests(records: DataFrame) -> DataFrame:
    """Digests of formatted records, all read back from ``formatted`` and ``loss_mask``."""
    got = records.withColumn("_back", read_back(F.col("formatted")))
    got = got.withColumn("_plain", F.transform("_back", lambda x: F.struct(x["role"].alias("role"), unescape(x["body"]).alias("text"))))
    got = got.withColumn("_learned", F.array_join(learned_texts(F.col("formatted"), F.col("loss_mask")), ""))
    whole = F.array_join(F.transform("_plain", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size("_back").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_learned").cast("bigint").alias("loss_chars"), F.sha2("_learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "layout",
    )
