"""Mining of chat transcripts: turns, code, calls, recovery from errors, wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.scalars import html_escaped

#: Wordings that are counted.  (?d) makes a dot stop at line feeds alone.
INVALID_API = [r"invalid api", r"api .* not found", r"no api named", r"unknown api", r"attributeerror: .*apis\.", r"has no attribute"]
ASSUMPTION = r"(?i)\b(?:assume|assumed|assuming)\b"
ASSUMPTION_EXTENDED = r"(?i)\b(?:assume|assumed|assuming|guess|guessed|guessing|suppose|supposed|supposing)\b"
DUMMY = r"(?i)\bdummy\b"
DUMMY_EXTENDED = r"(?i)\b(?:dummy|placeholder|fake|example)\b"
CAPITULATION = r"(?i)\b(?:cannot|can't|unable|give up)\b|instead assume|let'?s assume|dummy"
CALL = r"\bapis\.([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\s*\("
FENCE, OPEN_FENCE = r"(?is)```(?:python|py)\s*\n?(.*?)```", r"(?is)```(?:python|py)\s*\n?(.*)$"
#: Closed blocks one after another, from the start of a text to the end of the last.
CLOSED = r"(?is)\A(?:.*?```(?:python|py)\s*\n?.*?```)+"
#: The name space of calls that read documentation, and its calls that list an app's APIs and show one.
DOCS_APP, DESCRIBE, SHOW = "api_docs", "show_api_descriptions", "show_api_doc"
DOCS_CALL = r"\bapis\.api_docs\.{}\s*\([^)]*\)"
#: Any call with its arguments as far as a closing bracket; nothing after the name space is used up.
ANY_CALL = r"\bapis\.(?=([A-Za-z_][A-Za-z0-9_]*)\.([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)(\)?))"
APP_NAME, API_NAME = r"app_name\s*=\s*['\"]([^'\"]+)['\"]", r"api_name\s*=\s*['\"]([^'\"]+)['\"]"
#: What an observation of code that failed holds.
FAILED = "Execution failed."


def turn_pairs(messages: DataFrame, key: str | list[str], order: str, role: str = "role", text: str = "text", asks: tuple[str, ...] = ("assistant",), answers: tuple[str, ...] = ("user", "ipython")) -> DataFrame:
    """Each assistant message with the first answer before the next one, '' if there is none."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turns = messages.withColumn("turn_no", F.count_if(F.col(role).isin(*asks)).over(w)).filter("turn_no > 0")
    first = F.min_by(F.when(F.col(role).isin(*answers), F.col(text)), F.when(F.col(role).isin(*answers), F.col(order)))
    said = F.max(F.when(F.col(role).isin(*asks), F.col(text)))
    return turns.groupBy(*keys, "turn_no").agg(said.alias("said"), F.coalesce(first, F.lit("")).alias("observation"))


def count_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def invalid_api_hits(text: Column, patterns: list[str] = INVALID_API) -> Column:
    return reduce(lambda a, b: a + b, (count_pattern(text, f"(?id){p}") for p in patterns))


def code_blocks(text: Column) -> Column:
    """Fenced Python blocks, trimmed, and an unclosed one behind the last of them."""
    closed = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    rest = F.regexp_extract(F.regexp_replace(text, CLOSED, ""), OPEN_FENCE, 1)
    blocks = F.when(F.trim(F.regexp_replace(rest, r"\s+", " ")) != "", F.concat(closed, F.array(rest))).otherwise(closed)
    return F.transform(blocks, lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))


def code_text(text: Column) -> Column:
    """Fenced blocks, marked in lower case, each ended by a line feed, and then the last unclosed one; '' if there is no code."""
    closed = F.regexp_extract_all(text, F.lit(r"(?s)```(?:python|py)\n?(.*?)```"), F.lit(1))
    rest = F.regexp_replace(text, r"(?s)\A(?:.*?```(?:python|py)\n?.*?```)+", "")
    strip = lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")
    whole = F.array_join(F.transform(closed, lambda b: F.concat(strip(b), F.lit("\n"))), "")
    return F.coalesce(F.concat(whole, strip(F.regexp_extract(rest, r"(?s).*```(?:python|py)\n?(.*)", 1))), F.lit(""))


def code_events(code: Column) -> Column:
    """(kind, app, api) of a block's calls in the order of their places: description and doc of the documentation's, call of others.

    Documentation counts where its arguments name what is read and their bracket is closed.
    """
    apps, apis, arguments, ends = (F.regexp_extract_all(code, F.lit(ANY_CALL), F.lit(k)) for k in (1, 2, 3, 4))
    found = F.arrays_zip(apps.alias("app"), apis.alias("api"), arguments.alias("arguments"), ends.alias("end"))

    def event(c: Column) -> Column:
        docs = (c["app"] == DOCS_APP) & (c["end"] == ")")
        app, api = F.regexp_extract(c["arguments"], APP_NAME, 1), F.regexp_extract(c["arguments"], API_NAME, 1)
        kind = F.when(c["app"] != DOCS_APP, "call").when(docs & (c["api"] == DESCRIBE) & (app != ""), "description").when(docs & (c["api"] == SHOW) & (app != "") & (api != ""), "doc")
        other = c["app"] != DOCS_APP
        return F.struct(kind.alias("kind"), F.when(other, c["app"]).otherwise(app).alias("app"), F.when(other, c["api"]).otherwise(api).alias("api"))

    return F.filter(F.transform(found, event), lambda e: e["kind"].isNotNull())


def text_values(value: Column, kind: T.DataType) -> Column:
    """All strings in a column of any type, depth first, as an array; keys of maps and nulls don't count."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        found = F.array(value)
    elif isinstance(kind, T.StructType):
        parts = [text_values(value[f.name], f.dataType) for f in kind.fields if _holds_text(f.dataType)]
        found = F.concat(*parts) if parts else none
    elif isinstance(kind, T.ArrayType) and _holds_text(kind.elementType):
        found = F.flatten(F.transform(value, lambda x: text_values(x, kind.elementType)))
    elif isinstance(kind, T.MapType) and _holds_text(kind.valueType):
        found = F.flatten(F.transform(F.map_values(value), lambda x: text_values(x, kind.valueType)))
    else:
        found = none
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), none)


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    inner = {T.ArrayType: "elementType", T.MapType: "valueType"}.get(type(kind))
    return _holds_text(getattr(kind, inner)) if inner else isinstance(kind, T.StringType)


def api_calls(text: Column) -> Column:
    """(app, api) of every call outside the documentation name space."""
    apps, names = (F.regexp_extract_all(text, F.lit(CALL), F.lit(k)) for k in (1, 2))
    return F.filter(F.arrays_zip(apps.alias("app"), names.alias("api")), lambda c: c["app"] != DOCS_APP)


def recovery(calls: DataFrame, episode: str = "episode", turn: str = "turn", endpoint: str = "endpoint", failed: str = "failed") -> DataFrame:
    """Failed calls of each episode, those that a later turn makes without failing, and the share given up."""
    good = F.max(F.when(~F.col(failed), F.col(turn))).over(Window.partitionBy(episode, endpoint))
    bad = calls.withColumn("_good", good).filter(F.col(failed))
    counted = bad.groupBy(episode).agg(F.count("*").alias("n_failed"), F.count_if(F.col("_good") > F.col(turn)).alias("n_recovered"))
    return counted.withColumn("give_up_rate", F.coalesce(F.try_divide(F.col("n_failed") - F.col("n_recovered"), "n_failed"), F.lit(0.0)))


def documented_before(events: DataFrame, episode: str = "episode", pos: str = "pos", kind: str = "kind", app: str = "app", api: str = "api") -> DataFrame:
    """Calls, and those whose app was described or whose API was documented earlier in the episode."""
    by_app = F.min(F.when(F.col(kind) == "description", F.col(pos))).over(Window.partitionBy(episode, app))
    by_api = F.min(F.when(F.col(kind) == "doc", F.col(pos))).over(Window.partitionBy(episode, app, api))
    calls = events.withColumns({"_app": by_app, "_api": by_api}).filter(F.col(kind) == "call")
    known = F.coalesce(F.col("_app") < F.col(pos), F.lit(False)) | F.coalesce(F.col("_api") < F.col(pos), F.lit(False))
    return calls.groupBy(episode).agg(F.count("*").alias("n_calls"), F.count_if(known).alias("n_documented"))


def next_text(messages: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Adds next_text: the following message of the conversation."""
    return messages.withColumn("next_text", F.lead(text).over(Window.partitionBy(key).orderBy(order)))


#: What stands for an observation that is left out, and what ends one that is cut.
OMITTED, CUT = "[NOT SHOWN FOR BREVITY]", "\n[MESSAGE TOO LONG, TRUNCATED]"


def truncated_history(
    messages: DataFrame, key: str, order: str, role: str = "role", text: str = "text",
    n_prompt: int = 1, most: int = 60_000, most_message: int = 20_000, recent: int = 5,
) -> DataFrame:
    """The messages that are left when all after the first ``n_prompt`` of a conversation have to fit ``most`` characters.

    Three passes, each only as far as the length asks for it: early observations are left out (not among
    the last ``recent`` messages), observations above ``most_message`` are cut, and then the first messages
    go while more than ``recent`` remain.  Observations are the messages of ``ipython``, or of ``user`` in a
    conversation without any.  A null text counts as empty and stays null; ``order`` must be unique in a
    conversation.  All passes are windows over one sort by (key, order).
    """
    all_, so_far = Window.partitionBy(key), Window.partitionBy(key).orderBy(order)
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    own, place, left = F.col("_text"), F.col("_place"), F.col("_left")
    length = F.when(place >= 0, F.coalesce(F.length(own), F.lit(0))).otherwise(0).cast("long")

    def shortened(df: DataFrame, chosen: Column, new: Column, new_length: int) -> DataFrame:
        """Replaces chosen messages in order until the conversation fits."""
        df = df.withColumns({"_length": length, "_chosen": F.coalesce(chosen, F.lit(False))})
        gain = F.when(F.col("_chosen"), F.col("_length") - new_length).otherwise(0)
        df = df.withColumn("_before", F.sum("_length").over(all_) - F.coalesce(F.sum(gain).over(earlier), F.lit(0)))
        unfit = F.min(F.when(place >= 0, F.col("_before"))).over(so_far) > most
        return df.withColumn("_unfit", unfit).withColumn("_text", F.when(F.col("_chosen") & F.col("_unfit"), new).otherwise(own))

    kind = F.when(F.max(F.col(role) == "ipython").over(all_), "ipython").otherwise("user")
    df = messages.withColumns({"_text": F.col(text), "_place": F.row_number().over(so_far) - 1 - n_prompt, "_kind": kind})
    df = df.withColumns({"_left": F.count(F.lit(1)).over(all_) - n_prompt - place, "_seen": (place >= 0) & (F.col(role) == F.col("_kind"))})
    df = shortened(df, F.col("_seen") & (left > recent), F.lit(OMITTED), len(OMITTED))
    head = max(1, most_message - len(CUT))
    df = shortened(df, F.col("_seen") & (F.length(own) > most_message), F.concat(F.left(own, F.lit(head)), F.lit(CUT)), head + len(CUT))
    rest = F.sum(length).over(so_far.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("_rest", rest).filter((place < 0) | (F.col("_rest") <= most) | (left <= recent))
    return df.select(*(own.alias(c) if c == text else F.col(c) for c in messages.columns))


def report(messages: DataFrame, key: str, order: str, size: Column, role: str = "role", text: str = "text", n_prompt: int = 1) -> DataFrame:
    """One HTML fragment a conversation: each message with its number, role, size, running size and interaction."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = messages.withColumn("_size", F.coalesce(size, F.lit(0))).withColumns({"_no": F.row_number().over(w) - 1, "_sum": F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    turn = F.floor((F.greatest(F.lit(0), F.col("_no") - (n_prompt - 1)) + 1) / 2)
    title = F.concat_ws(" ", F.concat(F.lit("#"), F.col("_no")), F.concat(F.lit("size "), F.col("_size")), F.concat(F.lit("sum "), F.col("_sum")), F.concat(F.lit("interaction "), turn))
    role_, body = (html_escaped(F.coalesce(F.col(c), F.lit(""))) for c in (role, text))
    part = F.concat(F.lit('<section class="'), role_, F.lit('"><h3>'), title, F.lit("</h3><pre>"), body, F.lit("</pre></section>"))
    parts = F.sort_array(F.collect_list(F.struct(F.col("_no"), part.alias("part"))))
    return numbered.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("html"))
