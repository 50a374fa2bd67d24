"""Chat formatting: records of many layouts become canonical turns, and turns become a marked text with a loss mask.

A record is a JSON text. Its fingerprint is a hash of the set of its nested field paths (types and values left out). The
distinct fingerprints of a table are held against the layouts once each, by the paths that a layout needs, which gives a
small table from fingerprint to layout; records meet their layout by a join on the fingerprint. A layout is a declarative
mapping: a list of (role, path) for those with a field for each turn, or the path of the list of turns with the names of
its role and content fields.

The text marks turns with <|turn|> and <|end|>. A control string inside a role or text gets a backslash after its first
character, and one more if backslashes stand there already, so no text holds a marker and the change can be undone.
The loss mask is a list of spans: the number of the turn and the start and length, in code points, of the answer in that
turn's part of the text.

All of it is DataFrame functions. Edge cases: null texts are empty; turns without a role have an empty role; a record of
an unknown layout, or one that is no JSON object, has null turns; an empty list of turns gives an empty text; an empty table
gives no rows; repeated turns stay and are ordered by turn, role and text; a row without conv_id is a conversation of its
own; records may be as long and as deep as a string can be; extra fields of a record change its fingerprint and not its
layout; of a field that occurs twice the first counts, and field names must be written without escapes; columns of the
input with the names of the result's are replaced, all others are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

TURN, END = "<|turn|>", "<|end|>"
#: What common chat templates read as control strings, the first character and the rest; none stands inside another.
_FIRST, _REST = r"([<\[])", r"\\*(?:\|[A-Za-z_]+\|>|/?s>|/?SYS>|(?:start|end)_of_turn>|/?INST\])"
TURNS_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping from the records whose field paths include `needs` to turns."""

    name: str
    needs: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()  # (role, path)
    list_path: str = ""
    role_field: str = ""
    text_field: str = ""
    roles: tuple[tuple[str, str], ...] = ()  # names that stand for canonical roles


ROLES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("messages", ("messages", "messages[].content", "messages[].role"), list_path="messages", role_field="role", text_field="content", roles=ROLES),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), list_path="conversations", role_field="from", text_field="value", roles=ROLES),
    Layout("instruction_input", ("instruction", "input", "output"), turns=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", ("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
)


#: Options of the JSON parser: no bound on the length of a string, or on depth.
_PARSER = {"maxStringLen": "2147483647", "maxNestingDepth": "1000000", "maxNumLen": "2147483647"}
_SEND_ROWS = 100_000


def field_paths(record: Column) -> Column:
    """The set of nested field paths of a JSON text, in order: for example messages, messages[], messages[].content, messages[].role."""
    # escapes go first, so that a quote always ends a string; then all but brackets and field names goes
    bare = F.regexp_replace(record, r"(?s)\\.", "")
    bare = F.regexp_replace(bare, r'("[^"]*"\s*:)|"[^"]*"|[^\[\]{}"]+', "$1")
    tokens = F.regexp_extract_all(bare, F.lit(r'"[^"]*"|[\[\]{}]'), F.lit(0))
    state = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("seen"))

    def step(s, token):
        within = F.coalesce(F.element_at(s["open"], F.greatest(F.size(s["open"]), F.lit(1))), F.lit(""))
        name = F.substr(token, F.lit(2), F.length(token) - 2)
        field = F.when(F.size(s["open"]) > 1, F.concat(within, F.lit("."), name)).otherwise(name)
        each = F.concat(s["at"], F.lit("[]"))
        kept = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        below = F.coalesce(F.get(kept, F.size(kept) - 1), F.lit(""))

        def to(opened, at, seen):
            return F.struct(opened.alias("open"), at.alias("at"), seen.alias("seen"))

        return (
            F.when(token == "{", to(F.concat(s["open"], F.array(s["at"])), s["at"], s["seen"]))
            .when(token == "[", to(F.concat(s["open"], F.array(each)), each, F.array_union(s["seen"], F.array(each))))
            .when(token.isin("}", "]"), to(kept, below, s["seen"]))
            .otherwise(to(s["open"], field, F.array_union(s["seen"], F.array(field))))
        )

    return F.array_sort(F.aggregate(tokens, state, step, lambda s: s["seen"]))


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def layout_of(paths: Column) -> Column:
    """The name of the first layout whose paths are among those given; a list of turns may also be empty."""
    name = F.lit(None).cast("string")
    for layout in reversed(LAYOUTS):
        fits = F.size(F.array_except(F.array(*[F.lit(p) for p in layout.needs]), paths)) == 0
        if layout.list_path:
            each = f"{layout.list_path}[]"
            within = F.exists(paths, _begins(each + "."))
            fits = F.array_contains(paths, each) & (fits | ~within)
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
    return name


def _begins(text: str):
    return lambda x: x.startswith(text)


def _turn_of(layout: Layout):
    def turn(x):
        role = F.coalesce(x[layout.role_field], F.lit(""))
        meant = role
        for said, canonical in layout.roles:
            meant = F.when(role == said, F.lit(canonical)).otherwise(meant)
        return F.struct(meant.alias("role"), F.coalesce(x[layout.text_field], F.lit("")).alias("text"))

    return turn


def canonical_turns(record: Column, name: Column) -> Column:
    """The turns of a JSON record of the named layout; null if it is no JSON object."""
    fields = F.from_json(record, "map<string,string>", _PARSER)
    turns = F.lit(None).cast(TURNS_TYPE)
    for layout in LAYOUTS:
        if layout.list_path:
            own = F.from_json(fields[layout.list_path], f"array<struct<`{layout.role_field}`:string,`{layout.text_field}`:string>>", _PARSER)
            own = F.transform(own, _turn_of(layout))
        else:
            own = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(fields[path], F.lit("")).alias("text")) for role, path in layout.turns])
        turns = F.when(name == layout.name, F.when(fields.isNotNull(), own)).otherwise(turns)
    return turns


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + f"(?={_REST})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\(?=" + _REST + ")", "$1")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: Column, trained: str = "assistant") -> tuple[Column, Column]:
    """(formatted text, loss spans) of canonical turns."""

    def head(x):
        return F.concat(F.lit(TURN), _role_out(x["role"]), F.lit("\n"))

    text = F.array_join(F.transform(turns, lambda x: F.concat(head(x), escape(x["text"]), F.lit(END))), "")

    def span(x, i):
        own = F.struct(i.alias("turn"), F.length(head(x)).alias("start"), F.length(escape(x["text"])).alias("length"))
        return F.when(x["role"] == trained, own)

    return text, F.filter(F.transform(turns, span), lambda x: x.isNotNull())


def split_turns(formatted: Column) -> Column:
    """The parts of a formatted text, one for each turn, each with its marker."""
    parts = F.split(formatted, r"\Q" + TURN + r"\E")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.lit(TURN), x))


def parse_turns(formatted: Column) -> Column:
    """The turns back from a formatted text."""

    def turn(x):
        head = F.substring_index(x, "\n", 1)
        body = F.substr(x, F.length(head) + F.lit(2), F.length(x) - F.length(head) - F.lit(1 + len(END)))
        return F.struct(_role_in(F.substr(head, F.lit(len(TURN) + 1))).alias("role"), unescape(body).alias("text"))

    return F.transform(split_turns(formatted), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    parts = split_turns(formatted)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.get(parts, s["turn"]), s["start"] + F.lit(1), s["length"]))), "")


def layouts_of(shapes: DataFrame) -> DataFrame:
    """fingerprint, layout: one row for each distinct fingerprint. shapes: fingerprint, paths."""
    return shapes.groupBy("fingerprint").agg(F.min("paths").alias("paths")).select("fingerprint", layout_of(F.col("paths")).alias("layout"))


def format_records(df: DataFrame, record: str = "record") -> DataFrame:
    """df with fingerprint, layout, turns, formatted and loss_spans of its JSON records."""
    own = ("fingerprint", "layout", "turns", "formatted", "loss_spans")
    df = df.withColumn("__record", F.col(f"`{record}`").cast("string"))
    df = df.drop(*[c for c in own if c != record])
    paths = field_paths(F.col("__record"))
    table = staged(layouts_of(df.select(paths.alias("paths")).select(F.xxhash64("paths").alias("fingerprint"), "paths")), "chat-layouts")
    table = table.withColumnRenamed("fingerprint", "__print").withColumnRenamed("layout", "__layout")
    # as many rows as there are shapes; beyond the bound they are joined by a shuffle
    table = F.broadcast(table) if table.count() <= _SEND_ROWS else table
    df = df.withColumn("__own", F.xxhash64(paths)).join(table, F.col("__own") == F.col("__print"), "left")
    df = df.withColumn("fingerprint", F.col("__own")).withColumn("layout", F.col("__layout")).withColumn("turns", canonical_turns(F.col("__record"), F.col("__layout")))
    df = df.drop("__own", "__print", "__layout", "__record").withColumn("layout", F.when(F.col("turns").isNotNull(), F.col("layout")))
    text, spans = format_turns(F.col("turns"))
    return df.withColumn("formatted", text).withColumn("loss_spans", spans)


def records_of(rows: DataFrame) -> DataFrame:
    """conv_id, record: the JSON record, in the layout with a list of messages, of each conversation's rows (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("messages"))
    whole = whole.union(rows.where("conv_id is null").select("conv_id", F.array("turn")))
    messages = F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return whole.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """The digest columns, read back from the formatted text."""
    turns = formatted.withColumn("_turns", parse_turns(F.col("formatted"))).withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
