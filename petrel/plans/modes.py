"""Named modes over images and code views, with checked arguments."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrel.functions import text as T
from petrel.operators import decode, heuristics, layer0, memdiff
from petrel.operators.retrieval import clamp


def as_int(value: object, default: int, low: int, high: int) -> int:
    """Integer argument in a range; booleans and text that is no number are errors."""
    if value is None:
        return default
    if isinstance(value, bool) or not re.fullmatch(r"[+-]?\d+", str(value).strip()):
        raise ValueError(f"not an integer: {value!r}")
    if not low <= int(str(value)) <= high:
        raise ValueError(f"{value} is not in {low}..{high}")
    return int(str(value))


def as_bool(value: object, default: bool = False) -> bool:
    """Boolean argument; only true booleans and their names."""
    names = {"true": True, "false": False}
    if value is None:
        return default
    if isinstance(value, bool):
        return value
    if str(value).strip().lower() in names:
        return names[str(value).strip().lower()]
    raise ValueError(f"not a boolean: {value!r}")


def seeds(given: Iterable[object]) -> list[tuple[int, str]]:
    """(address, label) of addresses or of mappings with both; zero and what can't be read is dropped."""
    out = []
    for item in given:
        raw, label = (item.get("addr"), item.get("label")) if isinstance(item, Mapping) else (item, None)
        m = None if isinstance(raw, bool) or raw is None else re.fullmatch(r"(?:\$|0[xX])?([0-9A-Fa-f]{1,4})", str(raw).strip())
        addr = raw if isinstance(raw, int) and not isinstance(raw, bool) else int(m[1], 16) if m else 0
        if addr:
            out.append((addr & 0xFFFF, label or f"seed_{addr & 0xFFFF:04x}"))
    return out


def session_folder(name: str, existing: Iterable[str]) -> str:
    """Canonical slug, or the older spelling with the other separator if only that folder is there."""
    slug = re.sub(r"[^a-z0-9]+", "-", name.strip().lower()).strip("-")
    there = set(existing)
    return next((s for s in (slug, slug.replace("-", "_"), slug.replace("_", "-")) if s in there), slug)


def _code(dumps: DataFrame, entry: int | None, most: int) -> DataFrame:
    cells = decode.dump_bytes(dumps)
    boot = decode.boot_targets(dumps).select("dump_id", decode.resolve_entry(F.lit(entry if entry is not None else 0x0801), F.col("boot_target")).alias("entry"))
    return decode.recursive(decode.decode_all(cells), cells, boot, most)


def _loops(dumps: DataFrame, top_n: int) -> DataFrame:
    cells = decode.dump_bytes(dumps)
    all_of = decode.decode_all(cells)
    irq = decode.vectors(cells).where("vector = 788").select("dump_id", "target")
    boots = decode.boot_targets(dumps).where("boot_target is not null").select("dump_id", F.col("boot_target").alias("target"))
    return heuristics.loop_candidates(all_of, irq, boots, top_n)


def loops_with_listing(dumps: DataFrame, most: int = 300) -> tuple[DataFrame, DataFrame]:
    """Ranked loops and the recursive listing from each image's winner (Z3)."""
    ranked = _loops(dumps, 8)
    cells = decode.dump_bytes(dumps)
    best = ranked.where("place = 1").select("dump_id", F.col("top").alias("entry"))
    return ranked, decode.recursive(decode.decode_all(cells), cells, best, most, vectors_too=False)


#: Mode names and aliases of byte analytics; each takes images and arguments.
MODES: dict[str, Callable[..., DataFrame]] = {
    "linear": lambda d, entry=0x0801, count=600: decode.linear(decode.decode_all(decode.dump_bytes(d)), entry, clamp(count, 2000)),
    "recursive": lambda d, entry=None, count=600: _code(d, entry, clamp(count, 2000)),
    "loops": lambda d, count=8: _loops(d, clamp(count, 50)),
    "vectors": lambda d: decode.vectors(decode.dump_bytes(d)),
    "find_entry": decode.entry_candidates,
    "polymorphic": lambda d, entry=None: heuristics.self_modifying(_code(d, entry, 2000)),
    "data_refs": lambda d, entry=None: heuristics.data_refs(_code(d, entry, 2000)),
    "counters": lambda d, entry=None: heuristics.state_variables(_code(d, entry, 2000)),
    "idioms": lambda d, entry=None: heuristics.idioms(_code(d, entry, 2000)),
    "screen": lambda d: heuristics.screen_runs(decode.dump_bytes(d)),
    "banking": decode.banking,
}
ALIASES = {"disasm": "linear", "entry": "find_entry", "smc": "polymorphic", "state": "counters", "text": "screen"}


def dispatch(dumps: DataFrame, mode: str, **arguments: object) -> DataFrame:
    """The mode's rows; an unknown mode gives one row that says so."""
    name = ALIASES.get(mode.strip().lower(), mode.strip().lower())
    if name not in MODES:
        known = ", ".join(sorted(MODES | ALIASES))
        return dumps.sparkSession.createDataFrame([(False, f"unknown mode {mode!r}; known: {known}")], "ok boolean, error string")
    return MODES[name](dumps, **arguments)


def hardware_text(limit: int = 6000) -> str:
    """The register dimension as lines, clipped."""
    lines = [f"{chip}: ${lo:04X}-${hi:04X}" for lo, hi, chip in layer0.CHIPS] + [f"${a:04X} {n}: {role}" for a, (n, role) in sorted(layer0.REGISTERS.items())]
    return "\n".join(lines)[:limit]


# What an answer of each role holds at least: (alternatives of which one must be there, its type).
ROLES = {
    "planner": ((("plan",), "filled list"),),
    "executor": ((("args",), "object"), (("step_id", "tool"), "filled text")),
    "synthesizer": ((("labels", "routines", "data_structures", "hypotheses", "notes"), "any"),),
    "curator": ((("summary", "addresses_kept", "events_compacted"), "any"),),
    "critic": ((("decision",), "one of accept, revise, replan"),),
}


def contract_errors(rows: DataFrame, required: Mapping[str, str]) -> Column:
    """Problems of parsed answers against required fields: ``name: type``.

    Types: text, number, list, object, ``0..1`` (a number in that range), ``a|b`` (one of these).
    """
    checks = []
    for name, kind in required.items():
        value = F.get_json_object("answer", f"$.{name}")
        number = value.try_cast("double")
        if ".." in kind:
            low, high = map(float, kind.split(".."))
            fits = F.coalesce(number.between(low, high), F.lit(False))
        elif "|" in kind:
            fits = value.isin(*kind.split("|"))
        else:
            fits = {"text": F.trim(value) != "", "number": number.isNotNull(), "list": value.startswith("["), "object": value.startswith("{")}[kind]
        checks.append(F.when(value.isNull(), F.lit(f"{name} is missing")).when(~fits, F.lit(f"{name} is no {kind}")))
    return F.array_compact(F.array(*checks))


def role_error(role: str = "role", answer: str = "answer") -> Column:
    """The first rule of its role that an answer breaks, null if none; roles without rules accept any object."""
    out = F.when(~F.coalesce(F.col(answer).startswith("{"), F.lit(False)), F.lit("no object"))
    for name, rules in ROLES.items():
        for fields, kind in rules:
            values = [F.get_json_object(answer, f"$.{f}") for f in fields]
            fits = {
                "any": lambda v: v.isNotNull(), "filled list": lambda v: v.rlike(r"^\[\s*[^\s\]]"), "object": lambda v: v.startswith("{"), "filled text": lambda v: v != "",
                "one of accept, revise, replan": lambda v: v.isin("accept", "revise", "replan"),
            }[kind]
            good = F.lit(False)
            for v in values:
                good = good | F.coalesce(fits(v), F.lit(False))
            out = out.when((F.col(role) == name) & ~good, F.lit(f"{name}: {' or '.join(fields)} is no {kind}"))
    return out


def report(turn: Mapping[str, object]) -> str:
    """Markdown of one finished run (K6)."""
    lines = [f"# {turn.get('question', '')}", "", str(turn.get("answer", "")), "", f"- verdict: {turn.get('verdict', '')}", f"- confidence: {float(turn.get('confidence') or 0):.2f}"]
    return "\n".join(lines + [f"- evidence: {e}" for e in turn.get("evidence") or ()]) + "\n"


def diff_text(diff: DataFrame, top: int = 40) -> str:
    """Counts by region, then the first rows (A20); what reaches the driver is bounded by ``top`` and the regions."""
    regions = [f"{r['region']}={r['n']}" for r in memdiff.region_histogram(diff).groupBy("region").agg(F.sum("n").alias("n")).orderBy("region").collect()]
    first = diff.orderBy("addr").limit(top).select(F.concat(F.lit("  "), T.hex_label(F.col("addr")), F.lit(" ("), "region", F.lit("): "), F.col("old").cast("string"), F.lit(" -> "), F.col("new").cast("string")).alias("line")).collect()
    return "\n".join(["changed bytes by region: " + ", ".join(regions), *(r["line"] for r in first)]) if regions else "no differing bytes"
