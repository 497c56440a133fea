"""Chat formatting: layouts are known by a hash of their nested field paths.

Records come in many layouts (prompt and response, instruction and input, lists of
messages, one row for each turn). The fingerprint of a record is the SHA-256 of its nested
field paths, without types and values; all records of a table with columns of their own have
that of the table's schema, and a column of JSON gives each record its own. A registry maps fingerprints to declarative
mappings, each of which turns its layout into canonical turns: (conversation, turn, role,
text). Canonical turns are then written with a template that marks turns, escapes its own
control characters in texts reversibly, and reports the loss mask (what the assistant
says) as spans. Everything is made of DataFrame functions.

A conversation becomes one value, so all its turns meet in one task: its length bounds the
memory, not the number of conversations that share a layout, a role or a first turn.

Defined cases: null role or text counts as empty; turns with equal numbers are ordered by
role, then text; a record of unknown layout, of no turns or that is not JSON gives no turns
and is listed by ``unknown_layouts``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``sample`` is a record of the layout, its leaves of no meaning. ``items`` is the path of
    a list of messages with fields ``role`` and ``text``; without it, ``fields`` lists
    (role, paths): the texts at the paths, joined by a line feed, are one turn. ``roles``
    renames roles. With ``row``, a record is one turn itself: the paths of its conversation,
    number, role and text.
    """

    name: str
    sample: object
    items: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    row: tuple[str, str, str, str] | None = None


SHAREGPT = (("human", "user"), ("gpt", "assistant"))
REGISTRY = (
    Mapping("turn rows", {"conv_id": 0, "turn": 0, "role": "", "text": ""}, row=("conv_id", "turn", "role", "text")),
    Mapping("numbered contents", {"conversation_id": 0, "turn_index": 0, "role": "", "content": ""}, row=("conversation_id", "turn_index", "role", "content")),
    Mapping("messages", {"messages": [{"role": "", "content": ""}]}, items="messages"),
    Mapping("bare messages", [{"role": "", "content": ""}], items=""),
    Mapping("from and value", {"conversations": [{"from": "", "value": ""}]}, items="conversations", role="from", text="value", roles=SHAREGPT),
    Mapping("prompt and completion", {"prompt": "", "completion": ""}, fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", {"prompt": "", "response": ""}, fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system, prompt and response", {"system": "", "prompt": "", "response": ""}, fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", {"instruction": "", "output": ""}, fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction and input", {"instruction": "", "input": "", "output": ""}, fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question and answer", {"question": "", "answer": ""}, fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def _skeleton(sample: object) -> str:
    """The nested field paths of a sample, as Spark's description of a variant writes them, without types."""
    if isinstance(sample, dict):
        return "OBJECT<" + ", ".join(f"{k}: {_skeleton(sample[k])}" for k in sorted(sample)) + ">"
    if isinstance(sample, list):
        return f"ARRAY<{_skeleton(sample[0])}>"
    return ""


def layout_hash(sample: object) -> str:
    return hashlib.sha256(_skeleton(sample).encode()).hexdigest()


def _skeleton_of(schema: T.StructType) -> str:
    def sample(kind: T.DataType) -> object:
        if isinstance(kind, T.StructType):
            return {f.name: sample(f.dataType) for f in kind.fields}
        return [sample(kind.elementType)] if isinstance(kind, T.ArrayType) else ""

    return _skeleton(sample(schema))


def schema_hash(schema: T.StructType) -> str:
    """The fingerprint of a table's own columns."""
    return hashlib.sha256(_skeleton_of(schema).encode()).hexdigest()


def record_hash(variant: Column) -> Column:
    """The fingerprint of each record, whatever the types of its leaves."""
    described = F.schema_of_variant(variant)
    bare = F.regexp_replace(described, r"(?<=: |^|ARRAY<)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP(?:_NTZ)?|BINARY|VARIANT|DECIMAL\([0-9, ]+\))(?=[,>]|$)", "")
    return F.sha2(bare, 256)


def _turns(mapping: Mapping, text_at: Callable[[str], Column], list_at: Callable[[str, str, str], Column]) -> Column:
    """The turns of a record, whose texts and lists of (role, text) two functions take from their paths."""
    if mapping.items is not None:

        def turn(m: Column) -> Column:
            role = m[mapping.role]
            for old, new in mapping.roles:
                role = F.when(m[mapping.role] == old, F.lit(new)).otherwise(role)
            return F.struct(role.alias("role"), m[mapping.text].alias("text"))

        return F.transform(list_at(mapping.items, mapping.role, mapping.text), turn).cast(f"array<{TURN}>")
    made = []
    for role, paths in mapping.fields:
        texts = [text_at(p) for p in paths]
        texts = [texts[0], *(F.when(t != "", t) for t in texts[1:])]
        made.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *texts).alias("text")))
    return F.array(*made).cast(f"array<{TURN}>")


def _in_json(mapping: Mapping, variant: Column) -> Column:
    return _turns(
        mapping, lambda path: F.try_variant_get(variant, f"$.{path}", "string"),
        lambda path, role, text: F.try_variant_get(variant, f"$.{path}" if path else "$", f"array<struct<`{role}`:string,`{text}`:string>>"),
    )


def pick(schema: T.StructType, registry: tuple[Mapping, ...] = REGISTRY) -> Mapping | None:
    """The mapping whose layout has the fingerprint of the table, or else of most of its columns."""
    known = {layout_hash(m.sample): m for m in registry if isinstance(m.sample, dict)}
    if (whole := known.get(schema_hash(schema))) is not None:
        return whole
    parts = [m for m in known.values() if known.get(schema_hash(T.StructType([f for f in schema.fields if f.name in m.sample]))) is m]
    return max(parts, key=lambda m: len(m.sample), default=None)


def _parsed(records: DataFrame, key: str, record: str) -> DataFrame:
    parsed = records.select(F.col(key).alias("conv_id"), F.try_parse_json(F.col(record)).alias("v"))
    return parsed.withColumn("layout", record_hash(F.col("v")))


def canonical_turns(records: DataFrame, key: str = "conv_id", record: str = "record", registry: tuple[Mapping, ...] = REGISTRY) -> DataFrame:
    """conv_id, turn, role, text from a table of a known layout or from a column of JSON records of mixed layouts.

    The fingerprint of the table as read picks its mapping; columns that no layout names may
    stand beside. Without one, ``record`` holds JSON and each record's fingerprint picks its
    own; a table without that column raises ValueError. Layouts that aren't turns themselves
    take the conversation from ``key``.
    """
    mapping = pick(records.schema, registry)
    if mapping is not None and mapping.row:
        return records.select(*(F.col(path).alias(name) for path, name in zip(mapping.row, ("conv_id", "turn", "role", "text"), strict=True)))
    if mapping is not None:
        laid = records.select(F.col(key).alias("conv_id"), F.posexplode(_turns(mapping, lambda path: F.col(path).cast("string"), lambda path, role, text: F.col(path))).alias("turn", "t"))
    elif record in records.columns:
        parsed, turns = _parsed(records, key, record), F.lit(None).cast(f"array<{TURN}>")
        for m in registry:
            if not m.row:
                turns = F.when(F.col("layout") == layout_hash(m.sample), _in_json(m, F.col("v"))).otherwise(turns)
        laid = parsed.select("conv_id", F.posexplode(turns).alias("turn", "t"))
    else:
        raise ValueError(f"no mapping has the layout {_skeleton_of(records.schema)}, and there is no column {record}")
    return laid.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def unknown_layouts(records: DataFrame, key: str = "conv_id", record: str = "record", registry: tuple[Mapping, ...] = REGISTRY) -> DataFrame:
    """layout and n of the records that no mapping of the registry takes; a null layout is not JSON."""
    known = [layout_hash(m.sample) for m in registry]
    parsed = _parsed(records, key, record).filter(F.col("layout").isNull() | ~F.col("layout").isin(known))
    return parsed.groupBy("layout").agg(F.count(F.lit(1)).alias("n"))


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


#: After escaping, "<" stands in the template's own marks only.
READ = r"<turn>([^<]*)<says>\n([^<]*)</turn>\n"


def format_chat(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans of canonical turns.

    A turn is written ``<turn>ROLE<says>`` line feed TEXT ``</turn>`` line feed. loss_spans
    are the texts of the role ``learn``: start and length in characters, at and size in bytes
    of UTF-8, both from 0, over the formatted text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head, body = F.concat(F.lit("<turn>"), _escape(role), F.lit("<says>\n")), _escape(text)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("said"), head.alias("head"), body.alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit("</turn>\n")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "said").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda size: F.coalesce(F.sum(size("piece")).over(order), F.lit(0))
    rows = rows.select(
        "conv_id", "role", "head", "body", "piece", F.count(F.lit(1)).over(order).alias("nth"),
        (before(F.length) + F.length("head")).alias("start"), (before(F.octet_length) + F.octet_length("head")).alias("at"),
    )
    span = F.struct("start", F.length("body").cast("long").alias("length"), "at", F.octet_length("body").cast("long").alias("size"))
    said = F.sort_array(F.collect_list(F.struct("nth", "piece", F.when(F.col("role") == learn, span).alias("span"))))
    met = rows.groupBy("conv_id").agg(said.alias("said"))
    return met.select("conv_id", F.array_join("said.piece", "").alias("formatted"), F.filter("said.span", lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: Column) -> tuple[Column, Column]:
    """The roles and the texts of a formatted conversation, as arrays."""
    return tuple(F.transform(F.regexp_extract_all(formatted, F.lit(READ), F.lit(k)), _unescape) for k in (1, 2))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; cut by bytes, so each span costs its own length."""
    whole = F.encode(formatted, "UTF-8")
    return F.array_join(F.transform(spans, lambda s: _unescape(F.decode(F.substring(whole, (s["at"] + 1).cast("int"), s["size"].cast("int")), "UTF-8"))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts give when they are read back."""
    roles, texts = read_back(F.col("formatted"))
    seen = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), roles.alias("roles"), texts.alias("texts"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    listed = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return seen.select(
        "conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
