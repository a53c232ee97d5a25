"""Scalar column functions: names, keys, escapes, templates, safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that HTML escapes, in the order of replacement.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def slug(text: Column) -> Column:
    """Runs of anything but letters, digits, dots, underscores and hyphens become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")


def token_id(text: Column) -> Column:
    """Number in token_id:N; anything else is an error."""
    found = F.regexp_extract(text, r"^token_id:(\d+)$", 1).try_cast("int")
    return F.when(text.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("not a token id: "), text)).cast("int"))


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$") & ~text.rlike(r"[^\x00-\x7F]")


def scheme(uri: Column) -> Column:
    """Scheme of a URI, ``file`` if it has none; a single slash after the colon is taken for two."""
    return F.coalesce(F.nullif(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):/", 1), F.lit("")), F.lit("file"))


def padded_key(prefix: str, number: Column, width: int = 6) -> Column:
    """prefix-000012"""
    return F.format_string(f"{prefix}-%0{width}d", number)


def html_escaped(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def template_parts(text: Column) -> Column:
    """(role, text) of each part of a template whose parts begin with USER:, ASSISTANT: or SYSTEM: on a line."""
    parts = F.filter(F.split(text, r"(?m)^(?=(?:USER|ASSISTANT|SYSTEM):)"), lambda p: p.rlike(r"^(USER|ASSISTANT|SYSTEM):"))
    return F.transform(parts, lambda p: F.struct(F.lower(F.regexp_extract(p, r"^(\w+):", 1)).alias("role"), F.trim(F.regexp_replace(p, r"^\w+:", "")).alias("text")))


def prompt_messages(text: Column) -> Column:
    """(role, text) of the messages of a prompt: each begins with USER:, ASSISTANT: or SYSTEM: and a line feed and
    is taken as it stands; an error if the prompt does not begin with one."""
    header = r"(?:USER|ASSISTANT|SYSTEM):\n"
    parts = F.split(text, f"(?={header})", -1)
    bad = F.raise_error(F.lit("the start of the prompt has no role")).cast("array<string>")
    parts = F.when(text.rlike(rf"\A{header}"), parts).otherwise(bad)
    return F.transform(parts, lambda p: F.struct(F.lower(F.substring_index(p, ":", 1)).alias("role"), F.regexp_replace(p, rf"\A{header}", "").alias("text")))


def cut_at_break(text: Column, most: int, notice: str = "") -> Column:
    """A text of more than ``most`` characters cut at its last line break, else space, before there, plus a notice."""
    head = F.substring(text, 1, most)
    back = lambda c: F.length(head) - F.locate(c, F.reverse(head)) + 1
    place = F.when(F.contains(head, F.lit("\n")), back("\n")).when(F.contains(head, F.lit(" ")), back(" ")).otherwise(F.lit(most + 1))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(head, F.lit(1), place - 1), F.lit(notice)))


def transcript(messages: Column) -> Column:
    """``role: text`` lines of an array of structs."""
    return F.array_join(F.transform(messages, lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n")


def short_model(name: Column) -> Column:
    """Model name without folders and what follows -Instruct."""
    return F.substring_index(F.substring_index(name, "/", -1), "-Instruct", 1)


def safe_float(text: Column) -> Column:
    return text.try_cast("double")


def runners(total: Column, targets: Column, idle: Column) -> Column:
    """Runners in all: those of each device, one at least, on the idle devices."""
    return F.greatest(F.lit(1), F.ceil(F.try_divide(total, targets))) * idle


def best_candidate(candidates: Column) -> Column:
    """Index of the valid candidate of largest reward, the first of several; 0 if none is valid."""
    ranked = F.transform(candidates, lambda c, i: F.struct(c["valid"].alias("v"), F.when(c["valid"], c["reward"]).alias("r"), (-i).alias("i")))
    return -F.coalesce(F.array_max(F.filter(ranked, lambda c: c["v"]))["i"], F.lit(0))


def uri_parts(uri: Column) -> Column:
    """(scheme, path) of a URI: ``file`` without a scheme, one slash after the colon taken for two; a second :// is an error."""
    whole = F.regexp_replace(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):/+([^/])", "$1://$2")
    parts = F.split(whole, "://", -1)
    bad = F.raise_error(F.concat(F.lit("not a URI: "), uri)).cast("array<string>")
    parts = F.when(F.size(parts) == 1, F.array(F.lit("file"), whole)).when(F.size(parts) == 2, parts).otherwise(bad)
    return F.struct(parts[0].alias("scheme"), parts[1].alias("path"))


def least_known(a: Column, b: Column) -> Column:
    """The lesser of two, either of which may be null."""
    return F.least(a, b)


def safe_div(a: Column, b: Column) -> Column:
    """a / b of numbers in any form; null for what is no number and for a zero below."""
    return F.try_divide(a.try_cast("double"), b.try_cast("double"))


def compact(text: Column) -> Column:
    """Text without spaces."""
    return F.replace(text, F.lit(" "), F.lit(""))


def install_command(datasets: Column, program: str) -> Column:
    """One shell line that installs each dataset of a map from name to place, in order of their names."""
    entries = F.array_sort(F.map_entries(datasets))
    each = F.transform(entries, lambda e: F.concat(F.lit(f"{program} --mode install --dataset-name "), e["key"], F.lit(" --tasks-uri "), e["value"]))
    return F.when(F.size(entries) > 0, F.array_join(each, " && ")).otherwise(F.lit('echo "No extra datasets to install."'))


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounded with ties to the even digit."""
    return F.bround(value, digits)


def parsed_time(text: Column) -> Column:
    """A time in ISO form, without a zone; null where it is none."""
    return F.to_timestamp_ntz(F.regexp_replace(text, " ", "T"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def stamp(time: Column) -> Column:
    """20240131T235959Z"""
    return F.date_format(time, "yyyyMMdd'T'HHmmss'Z'")


def overlaid(*maps: Column) -> Column:
    """One map in which later maps' values win; keys stand in the order first seen."""
    keys = F.array_distinct(F.flatten(F.array(*map(F.map_keys, maps))))
    value = lambda k: F.coalesce(*(F.try_element_at(m, k) for m in reversed(maps)))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(k))))


def chunks(items: Column, size: int) -> Column:
    """An array cut to arrays of ``size``, the last as it comes."""
    n = F.ceil(F.size(items) / size).cast("int")
    whole = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.slice(items, k * size + 1, F.lit(size)))
    return F.when(n > 0, whole).otherwise(F.slice(whole, 1, 0))


def ports(start: Column, n: Column, step: int = 2) -> Column:
    """``n`` ports from ``start`` on, ``step`` apart."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: start + k * step)).otherwise(F.array().cast("array<int>"))


def new_tokens(prompt: Column, most_new: int, most_all: int) -> Column:
    """Tokens that may be generated after a prompt: ``most_new``, or what is left of ``most_all`` less one; null if that is one or none."""
    left = F.when(prompt + most_new >= most_all, most_all - prompt - 1).otherwise(F.lit(most_new))
    return F.when(left > 1, left)


def message_kind(role: Column, generated: Column) -> Column:
    """system, user, ipython, assistant, or policy for an assistant's message with generated tokens; other roles are an error."""
    bad = F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))).cast("string")
    return F.when((role == "assistant") & generated.isNotNull(), "policy").when(role.isin("system", "user", "ipython", "assistant"), role).otherwise(bad)


def score(answer: Column, scores: Column, default: float = -1.0) -> Column:
    """The score of an answer, ``default`` for one that has none."""
    return F.coalesce(F.try_element_at(scores, answer), F.lit(default))


def valid_candidate(output: Column, no_code: Column) -> Column:
    """Whether a candidate's code was there and ran."""
    return ~F.contains(output, F.lit("Execution failed.")) & ~no_code
