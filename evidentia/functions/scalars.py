"""Scalar rules as Columns: severities, paths, ids, cuts and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities by rank, and what they map to.
RANKS = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITIES = ["critical", "high", "medium", "low", "info"]
CONFIDENCES = ["high", "medium", "low"]
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
RISKS = {"critical": ("critical", "high"), "high": ("high", "high"), "medium": ("moderate", "moderate"), "low": ("low", "low")}
VERSION_OPERATORS = ["==", ">=", "<=", "~=", "!=", ">", "<"]
MARKER = " […truncated; call query_finding_detail(id) for full text…]"


def cases(value: Column, table: dict, default) -> Column:
    """``CASE value WHEN key THEN ...`` over a small fixed table."""
    out = None
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def severity_rank(severity: Column) -> Column:
    return cases(severity, RANKS, 0)


def sarif_level(severity: Column) -> Column:
    return cases(severity, SARIF_LEVELS, "note")


def risk_priority(severity: Column) -> Column:
    """Struct (risk, priority); other severities are unknown, low."""
    pick = lambda i: cases(severity, {k: v[i] for k, v in RISKS.items()}, ("unknown", "low")[i])
    return F.struct(pick(0).alias("risk"), pick(1).alias("priority"))


def known_severity(text: Column) -> Column:
    """A stored severity: one of the domain, else info."""
    return F.when(F.lower(text).isin(SEVERITIES), F.lower(text)).otherwise("info")


def known_confidence(text: Column) -> Column:
    return F.when(F.lower(text).isin(CONFIDENCES), F.lower(text)).otherwise("low")


def leaf(symbol: Column) -> Column:
    """What follows the last ``.`` or ``:``."""
    return F.regexp_extract(symbol, r"([^.:]*)$", 1)


def without_root(path: Column, root: str = "/repo/") -> Column:
    """The path without the scanner's mount point in front."""
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def cut_chars(text: Column, most: int, marker: str = MARKER) -> Column:
    """The first ``most`` characters, with a marker where something went."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole code points within ``most`` UTF-8 bytes."""
    data = F.encode(text, "UTF-8")
    inside = lambda p: F.hex(F.substring(data, p + 1, 1)).between("80", "BF")  # noqa: E731  the cut after byte p splits a code point
    at = F.when(~inside(most), most)
    for back in (1, 2, 3):
        at = at.when(~inside(most - back), most - back)
    # substr on binary counts bytes
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(data.substr(F.lit(1), at.otherwise(most)), "UTF-8"))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def line_range(text: Column) -> Column:
    """Struct (first, last) of ``"7"`` or ``"7-9"``; what is no number is 0, a missing end is the start."""
    parts = F.split(text, "-")
    first = F.coalesce(F.trim(F.get(parts, 0)).try_cast("int"), F.lit(0))
    return F.struct(first.alias("first"), F.coalesce(F.trim(F.get(parts, 1)).try_cast("int"), first).alias("last"))


def split_requirement(line: Column) -> Column:
    """Struct (name, version_spec): cut at the first operator of the list, in its
    order, that occurs in the line; extras in brackets are not part of the name."""
    bare = F.trim(F.regexp_replace(line, r"\s+#.*$", ""))
    name, spec = bare, F.lit("")
    for op in reversed(VERSION_OPERATORS):
        at = F.instr(bare, op)
        name = F.when(at > 0, F.substring_index(bare, op, 1)).otherwise(name)
        spec = F.when(at > 0, bare.substr(at, F.length(bare))).otherwise(spec)
    return F.struct(F.trim(F.regexp_replace(name, r"\[.*$", "")).alias("name"), F.trim(spec).alias("version_spec"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def minted_id(prefix: Column, ordinal: Column) -> Column:
    """``<prefix>-NNNN``; numbers past 9999 keep all their digits."""
    text = ordinal.cast("string")
    return F.concat_ws("-", prefix, F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))


def eng8(engagement_id: Column) -> Column:
    return F.substring(F.regexp_replace(engagement_id, "-", ""), 1, 8)


def envelope_id(scan: Column, tool: Column, content: Column) -> Column:
    """Content address: scan, tool and the first 12 hex digits of SHA-256."""
    return F.concat_ws("-", scan, tool, F.substring(F.sha2(content, 256), 1, 12))


# Languages with a sandbox, by extension.
SANDBOXES = {
    "py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "go": "go", "php": "php", "java": "java",
}
# Domains of tool arguments; a list of words or a pattern. Paths are
# relative and stay below their root.
ARGUMENTS: dict[str, list[str] | str] = {
    "audit_language": ["python", "typescript", "rust", "go"], "severity_level": ["info", "low", "medium", "high", "critical"],
    "confidence_level": ["low", "medium", "high"], "semgrep_ruleset": ["auto", "security-audit", "secrets", "owasp-top-ten"],
    "cwe_id": r"^CWE-[0-9]+\z", "file_path": r"^(?!/)(?!(.*/)?\.\.(/|\z))[A-Za-z0-9_./\-]+\z",
}


def extension(path: Column) -> Column:
    """What follows the last dot of the last part of a path, lower-cased; null without one.
    A name that only begins with a dot has none."""
    found = F.regexp_extract(F.regexp_extract(path, r"([^/]*)/*$", 1), r"^.+\.([^.]*)$", 1)
    return F.nullif(F.lower(found), F.lit(""))


def sandbox_language(path: Column) -> Column:
    """The language whose sandbox runs a file; null where there is none."""
    return cases(extension(path), SANDBOXES, None)


def valid_argument(value: Column, kind: str) -> Column:
    """Whether a tool's argument lies in the domain of its kind; null does not."""
    domain = ARGUMENTS[kind]
    return F.coalesce(value.rlike(domain) if isinstance(domain, str) else value.isin(domain), F.lit(False))


def from_rfc3339(text: Column) -> Column:
    """The instant of an RFC 3339 text, null where it is none."""
    fine = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.when(fine, F.upper(text).try_cast("timestamp"))


def to_rfc3339(ts: Column) -> Column:
    """UTC with microseconds where there are any: ``2026-01-02T03:04:05+00:00``."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    micros = F.date_format(utc, "SSSSSS")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def path_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def canonical_model(name: Column) -> Column:
    """A model name without its routing prefix, dots as dashes."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.", "-")


def tier(text: Column) -> Column:
    """Struct (provider, model) cut at the first colon."""
    return F.struct(F.substring_index(text, ":", 1).alias("provider"), F.regexp_extract(text, "^[^:]*:(.*)$", 1).alias("model"))


def cost(input_tokens: Column, output_tokens: Column, input_price: float = 3.0, output_price: float = 15.0) -> Column:
    """Linear cost, prices for a million tokens."""
    return input_tokens * input_price / 1_000_000 + output_tokens * output_price / 1_000_000
