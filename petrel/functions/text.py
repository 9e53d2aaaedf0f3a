"""Scalar text, address and identity functions as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that carry no search meaning.
STOP_WORDS = ("the", "and", "for", "with", "what", "does", "how", "where", "which", "that", "this", "from", "are", "was", "why", "when", "who", "is", "in", "of", "to")
REDACTED = "[REDACTED]"


def parse_address(text: Column) -> Column:
    """Strict: optional ``$`` or ``0x``, then one to four hex digits; null otherwise."""
    digits = F.regexp_extract(F.trim(text.cast("string")), r"^(?:\$|0[xX])?([0-9A-Fa-f]{1,4})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("int"))


def parse_address_lenient(text: Column) -> Column:
    """``$``/``0x`` is hex; a bare string decimal first, then hex; masked to 16 bits."""
    t = F.trim(text.cast("string"))
    marked = F.regexp_extract(t, r"^(?:\$|0[xX])([0-9A-Fa-f]{1,8})$", 1)
    decimal = F.regexp_extract(t, r"^([0-9]{1,9})$", 1)
    bare = F.regexp_extract(t, r"^([0-9A-Fa-f]{1,8})$", 1)
    hexed = lambda c: F.conv(c, 16, 10).cast("long")
    value = F.when(marked != "", hexed(marked)).when(decimal != "", decimal.try_cast("long")).when(bare != "", hexed(bare))
    return F.pmod(value, F.lit(0x10000)).cast("int")


def hex_addresses(text: Column, limit: int = 16) -> Column:
    """Unique ``$XXXX`` and ``0xXXXX`` in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:\$|0[xX])([0-9A-Fa-f]{2,4})(?![0-9A-Fa-f])"), 1)
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.conv(x, 16, 10).cast("int"))), 1, limit)


def prose_addresses(text: Column) -> Column:
    """Starts of ranges first, then single addresses, in order and without repeats."""
    t = F.coalesce(text, F.lit(""))
    ranges = F.regexp_extract_all(t, F.lit(r"\$([0-9A-Fa-f]{4})\s*[-–—]\s*\$?[0-9A-Fa-f]{4}"), 1)
    rest = F.regexp_replace(t, r"\$[0-9A-Fa-f]{4}\s*[-–—]\s*\$?[0-9A-Fa-f]{4}", " ")
    singles = F.regexp_extract_all(rest, F.lit(r"\$([0-9A-Fa-f]{4})(?![0-9A-Fa-f])"), 1)
    return F.array_distinct(F.transform(F.concat(ranges, singles), lambda x: F.conv(x, 16, 10).cast("int")))


def hex_digits(number: Column, digits: int) -> Column:
    """Capital hex digits, so many at least; larger numbers keep all of theirs, which a plain ``lpad`` would cut."""
    h = F.hex(number.cast("long"))
    return F.lpad(h, F.greatest(F.length(h), F.lit(digits)), "0")


def hex_label(addr: Column, digits: int = 4) -> Column:
    """``$C000`` style."""
    return F.concat(F.lit("$"), hex_digits(addr, digits))


def signed_delta(new: Column, old: Column) -> Column:
    """Signed difference of two bytes, from -128 to 127."""
    return (F.pmod(new.cast("int") - old.cast("int") + 128, F.lit(256)) - 128).cast("int")


def word(lo: Column, hi: Column) -> Column:
    """Little-endian 16-bit word."""
    return (lo.cast("int") + hi.cast("int") * 256).cast("int")


def screen_char(code: Column) -> Column:
    """Screen code to text; bit 7 ignored; null for padding and graphics."""
    c = code.bitwiseAND(0x7F)
    return F.when((c >= 1) & (c <= 0x1F), F.char(c + 0x40)).when((c >= 0x20) & (c <= 0x3F), F.char(c))


def operand_facts(op: Column) -> dict[str, Column]:
    """addr, index, indirect of a memory operand in either dialect; null addr if there is none."""
    s = F.trim(F.regexp_replace(F.coalesce(op, F.lit("")), r"0[xX]", r"\$"))
    shape = r"^(\()?\s*\$([0-9A-Fa-f]{1,4})\s*(?:,\s*([xyXY]))?\s*\)?(?:\s*,\s*([xyXY]))?$"
    digits = F.regexp_extract(s, shape, 2)
    index = F.lower(F.concat(F.regexp_extract(s, shape, 3), F.regexp_extract(s, shape, 4)))
    hit = digits != ""
    return {
        "addr": F.when(hit, F.conv(digits, 16, 10).cast("int")), "index": F.when(hit & (index != ""), F.substring(index, 1, 1)),
        "indirect": F.when(hit, F.regexp_extract(s, shape, 1) == "("),
    }


def direct_target(op: Column) -> Column:
    """Absolute target without index or brackets."""
    d = F.regexp_extract(F.trim(op), r"^(?:0[xX]|\$)([0-9A-Fa-f]{1,4})$", 1)
    return F.when(d != "", F.conv(d, 16, 10).cast("int"))


def indirect_vector(op: Column) -> Column:
    d = F.regexp_extract(F.trim(op), r"^\(\s*(?:0[xX]|\$)([0-9A-Fa-f]{1,4})\s*\)$", 1)
    return F.when(d != "", F.conv(d, 16, 10).cast("int"))


def store_target(op: Column) -> Column:
    """Absolute or indexed target beyond the zero page."""
    d = F.regexp_extract(F.trim(op), r"^(?:0[xX]|\$)([0-9A-Fa-f]{1,4})(?:\s*,\s*[xyXY])?$", 1)
    v = F.when(d != "", F.conv(d, 16, 10).cast("int"))
    return F.when(v > 0xFF, v)


def label_ref(op: Column) -> Column:
    """Symbol of an operand that is a bare name, an index aside."""
    name = F.regexp_extract(F.trim(op), r"^([A-Za-z_][A-Za-z0-9_]*)(?:\s*,\s*[XYxy])?$", 1)
    return F.when((name != "") & (F.lower(name) != "a"), name)


def canonical_operand(op: Column) -> Column:
    """Comment stripped, hex as ``$`` with capital digits (S5): symbols keep their case."""
    bare = F.trim(F.regexp_replace(F.coalesce(op, F.lit("")), r"\s*;.*$", ""))
    dollar = F.regexp_replace(bare, r"0x([0-9a-fA-F]+)", r"\$$1")
    tokens = F.regexp_extract_all(dollar, F.lit(r"(\$[0-9a-fA-F]+|[^$]+|\$)"), 1)
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^\$[0-9a-fA-F]+$"), F.upper(t)).otherwise(t)), "")


def canonical_json(value: object, separators: tuple[str, str] = (",", ":"), prefix: str = "") -> str:
    """Sorted-key JSON for identities; separators and prefix differ by store (X11)."""
    return prefix + json.dumps(value, sort_keys=True, separators=separators, ensure_ascii=True, default=str)


def identity(text: Column, length: int = 64) -> Column:
    """Leading hex digits of a SHA-256 (X11)."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def clip(text: Column, limit: int, marker: str = "…[truncated]") -> Column:
    """X15."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def question_terms(text: Column, least: int = 3, most: int = 8, stop: Sequence[str] = STOP_WORDS) -> Column:
    """First unique words that are no stop words, in lower case."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([A-Za-z_][A-Za-z0-9_]{{{least - 1},}})"), 1)
    lowered = F.transform(words, lambda w: F.lower(w))
    return F.slice(F.array_distinct(F.filter(lowered, lambda w: ~w.isin(*stop))), 1, most)


def snippet(text: Column, anchor: Column, chars: int = 240) -> Column:
    """Text around the first hit of the anchor, with dots where it was cut."""
    radius = max(40, chars // 3)
    at = F.locate("\u0000", F.lit("")) if anchor is None else F.call_function("locate", F.lower(anchor), F.lower(text))
    start = F.greatest(F.lit(1), at - radius)
    end = F.least(F.length(text), at - 1 + radius + F.length(anchor))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at == 0, F.substring(text, 1, chars)).otherwise(cut)


def lexical_overlap(query_terms: Column, text_terms: Column) -> Column:
    """Share of the query's terms that the text has."""
    n = F.size(query_terms)
    return F.when(n > 0, F.size(F.array_intersect(query_terms, text_terms)) / n).otherwise(0.0)


def slug(text: Column, limit: int = 64) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, limit)


def identifier(text: Column, limit: int = 64) -> Column:
    """A name fit for an assembler: other characters as underscores, no digit first."""
    clean = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9_]", "_")
    return F.substring(F.when(clean.rlike(r"^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean), 1, limit)


def parse_time(text: Column) -> Column:
    """ISO-8601 as a timestamp, UTC where no zone is given; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, r"Z$", "+00:00"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from one to the other, never negative."""
    return F.greatest(F.lit(0.0), end.cast("double") - start.cast("double"))


def hex_bytes(text: Column) -> Column:
    """Payload written as hex pairs, separators allowed; never decimal; null if odd or not hex."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?:0[xX]|\$)", ""), r"[\s,]+", "")
    return F.when(digits.rlike(r"^(?:[0-9A-Fa-f]{2})*$") & (digits != ""), F.unhex(digits))


# Shapes of credentials, of addresses that only look like them, and names that hold secrets.
_PREFIXED = r"(?:sk-(?:proj-|ant-)?|xai-|tvly-|gh[opusr]_|AIza)[A-Za-z0-9._-]{12,}"
_JWT = r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
_MIXED = r"(?=[^\s\"'`,;\]}]*[A-Za-z])(?=[^\s\"'`,;\]}]*[0-9])[A-Za-z0-9._~+/=-]{24,}"
_NAMES = r"api[_-]?key|access[_-]?token|auth[_-]?token|refresh[_-]?token|client[_-]?secret|secret|password|passwd|authorization"
_ADDRESS = r"\$(?:[0-9A-Fa-f]{2}|[0-9A-Fa-f]{4})"
#: Where one of these is, a text may hold something to mask; others are left alone after one look.
_HINT = r"(?i)PRIVATE KEY|://|bearer|key|token|secret|passw|authorization|sk-|xai-|tvly-|gh[opusr]_|aiza|[\w-]{8}\.[\w-]{8}"
#: (pattern, what stays around the mask as groups before and after), in the order in which they apply.
_MASKS = (
    (r"(?s)()-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----()", ("", "")),
    (r"(?i)(\b[a-z][a-z0-9+.-]*://[^\s/@:]+:)[^\s/@]+(@)", ("1", "2")),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}", ("Bearer ", "")),
    (rf"(?<![A-Za-z0-9_-]){_JWT}(?![A-Za-z0-9_-])", ("", "")),
    (rf"((?i:[\"']?[A-Za-z0-9_.-]*(?:{_NAMES})[\"']?\s*[:=]\s*))([\"']?)(?:{_PREFIXED}|{_JWT}|{_MIXED})(?![^\s\"'`,;\]}}])\2", ("12", "2")),
    (rf"(?<![A-Za-z0-9]){_PREFIXED}", ("", "")),
)


def _replacement(around: tuple[str, str], group: str) -> str:
    """Mask between what stays, with groups written as the pattern engine at hand wants them."""
    before, after = ("".join(group.format(c) for c in x) if x.isdigit() else x for x in around)
    return before + REDACTED + after


def redact(text: Column | str) -> Column:
    """Credentials masked; order of the rules matters and repeating them changes nothing (X12). Pattern functions only, no Python per row."""
    t = F.col(text) if isinstance(text, str) else text
    masked = t
    for pattern, around in _MASKS:
        masked = F.regexp_replace(masked, pattern, _replacement(around, "${}"))
    return F.when(t.rlike(_HINT), masked).otherwise(t)


_COMPILED = [(re.compile(pattern), _replacement(around, "\\{}")) for pattern, around in _MASKS]
_SECRET_KEY = re.compile(rf"(?i)(?:^|[_.-])(?:{_NAMES})$")


def _mask_secrets(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """An object of a JSON text as it is read: what a secret-like key holds becomes the mask, but for null and addresses."""
    out = dict(pairs)
    for key, value in out.items():
        harmless = value is None or (isinstance(value, str) and re.fullmatch(_ADDRESS, value.strip()))
        if not harmless and _SECRET_KEY.search(key):
            out[key] = REDACTED
    return out


def _scrub(node: object) -> object:
    match node:
        case str():
            for pattern, to in _COMPILED:
                node = pattern.sub(to, node)
            return node
        case dict():
            return {k: _scrub(v) for k, v in node.items()}
        case list():
            return [_scrub(v) for v in node]
    return node


@F.pandas_udf(StringType())
def redact_json(text: pd.Series) -> pd.Series:
    """JSON with strings redacted, and whatever stands under a secret-like key; addresses survive (X13). Other text is redacted as such."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(_scrub(json.loads(t, object_pairs_hook=_mask_secrets)), sort_keys=True)
        except ValueError:
            return _scrub(t)

    return text.map(one)


def _blocks(text: str) -> list[str]:
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    return paragraphs if len(paragraphs) > 1 else [x.strip() for x in text.splitlines() if x.strip()]


def _chunks(text: str, size: int, overlap: int) -> list[str]:
    size, overlap = max(64, size), max(0, min(overlap, max(64, size) // 2))
    parts: list[str] = []
    open_part = False  # whether the last part may still grow
    for block in _blocks(text):
        if len(block) > size:
            parts += [p for i in range(0, len(block), max(1, size - overlap)) if (p := block[i : i + size].strip())]
            open_part = False
        elif open_part and len(parts[-1]) + 2 + len(block) <= size:
            parts[-1] += "\n\n" + block
        else:
            parts.append(block)
            open_part = True
    if not overlap:
        return parts
    tails = ["", *(p[-overlap:].strip() for p in parts[:-1])]
    return [(f"{t}\n{p}".strip() if t else p)[-size:] for t, p in zip(tails, parts, strict=True)]


def chunk_text(text: Column, size: int = 700, overlap: int = 120) -> Column:
    """Paragraphs, or else lines, packed into chunks that overlap."""

    @F.pandas_udf(ArrayType(StringType()))
    def split(values: pd.Series) -> pd.Series:
        return values.map(lambda t: _chunks(t or "", size, overlap))

    return split(text)


def _salvage(text: str) -> str | None:
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            value, _ = decoder.raw_decode(text, m.start())
            return json.dumps(value, sort_keys=True)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def salvage_json(text: pd.Series) -> pd.Series:
    """The first JSON object or array inside prose, in canonical form; null if none."""
    return text.map(lambda t: None if t is None else _salvage(t))
