"""Report sinks: canonical JSON, Markdown, plain text; sensitive fields redacted."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# fixed values: the names of fields and the forms of values that are masked in audit reports
SENSITIVE_KEYS = ("pass(word)?", "secret", "token", "api[_-]?key", "private[_-]?key", "auth(orization)?", "bearer", "cookie", "credential")
SENSITIVE_VALUES = ("-----BEGIN [A-Z ]*PRIVATE KEY-----", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")

SENSITIVE = r"(?i)(secret|password|token|private|api_?key|credential)"


def canonical_number(x: float) -> str:
    """The shortest digits that round-trip, laid out as ECMAScript does: what RFC 8785 asks for."""
    if not math.isfinite(x):
        raise ValueError("only finite numbers have a canonical form")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    d, n = "".join(map(str, digits)), exponent + len(digits)  # 0.d * 10**n
    if len(d) <= n <= 21:
        out = d + "0" * (n - len(d))
    elif 0 < n <= 21:
        out = f"{d[:n]}.{d[n:]}"
    elif -6 < n <= 0:
        out = "0." + "0" * -n + d
    else:
        out = d[0] + ("." + d[1:] if len(d) > 1 else "") + f"e{'+' if n > 0 else '-'}{abs(n - 1)}"
    return "-" * sign + out


def canonical_json(value: object) -> str:
    """RFC 8785: keys by UTF-16 units, no spaces, shortest numbers."""
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        if abs(value) > 2**53 - 1:
            raise ValueError("integers beyond 2^53 - 1 have no canonical form")
        return str(value)
    if isinstance(value, float):
        return canonical_number(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    raise TypeError(f"{type(value).__name__} has no canonical form")


def redact(fields: Column) -> Column:
    """A map with the values of sensitive keys masked."""
    return F.transform_values(fields, lambda k, v: F.when(k.rlike(SENSITIVE), F.lit("[REDACTED]")).otherwise(v))


def _masked(value: Column) -> Column:
    """A value's stand-in: equal values stay equal, nothing else is left of them."""
    return F.when(value.isNotNull(), F.concat(F.lit("[REDACTED_SECRET:sha256_"), F.substring(F.sha2(value, 256), 1, 12), F.lit("]")))


def _text(value: Column, kind: DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (StructType, ArrayType, MapType)) else value.cast("string")


def _clean(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        fields = [(_masked(_text(value[f.name], f.dataType)) if re.search("|".join(SENSITIVE_KEYS), f.name, re.IGNORECASE) else _clean(value[f.name], f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _clean(x, kind.elementType))
    if isinstance(kind, MapType):
        values = F.transform_values(value, lambda _, v: _clean(v, kind.valueType))
        if not isinstance(kind.valueType, StringType):
            return values
        return F.transform_values(value, lambda k, v: F.when(k.cast("string").rlike("(?i)" + "|".join(SENSITIVE_KEYS)), _masked(v)).otherwise(_clean(v, kind.valueType)))
    if isinstance(kind, StringType):
        return F.when(value.rlike("|".join(SENSITIVE_VALUES)), _masked(value)).otherwise(value)
    return value


def redacted(df: DataFrame) -> DataFrame:
    """df with every sensitive field masked at any depth of structs, arrays and maps: by its name (its type becomes string), or by what its text looks like.
    Of maps whose values aren't texts only the texts within are looked at."""
    fields = [_masked(_text(F.col(f"`{f.name}`"), f.dataType)) if re.search("|".join(SENSITIVE_KEYS), f.name, re.IGNORECASE) else _clean(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(*(c.alias(f.name) for c, f in zip(fields, df.schema.fields, strict=True)))


def audit_report(evidence: DataFrame, assets: DataFrame, findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row for each project: n_assets, n_evidence, n_detection, n_proof, n_policy, domains (map of counts), findings (map by severity), peak_asset_id, peak_risk, decision (the gravest
    of its assets'), n_by_decision, content_hash over the lot. evidence: project_id, domain, layer; assets: project_id, asset_id, risk; findings: project_id, severity; decisions:
    project_id, asset_id, decision. Aggregates a project, joined by project: no list of rows is made."""
    layer = lambda x: F.count(F.when(F.col("layer") == x, 1))
    facts = evidence.groupBy("project_id").agg(F.count("*").alias("n_evidence"), layer("DETECTION").alias("n_detection"), layer("PROOF").alias("n_proof"), layer("POLICY").alias("n_policy"))

    def counted(df: DataFrame, column: str, name: str) -> DataFrame:
        n = df.where(F.col(column).isNotNull()).groupBy("project_id", F.col(column).alias("k")).agg(F.count("*").alias("v"))  # a few kinds a project
        return n.groupBy("project_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))

    worst = assets.groupBy("project_id").agg(F.count("*").alias("n_assets"), F.max("risk").alias("peak_risk"), F.min_by("asset_id", F.struct(-F.col("risk"), "asset_id")).alias("peak_asset_id"))
    order = F.array(*(F.lit(x) for x in ("ACCEPT", "REVIEW", "QUARANTINE", "REJECT")))
    gravest = decisions.groupBy("project_id").agg(F.element_at(order, F.max(F.array_position(order, F.col("decision"))).cast("int")).alias("decision"))
    out = worst.join(facts, "project_id", "full_outer").join(counted(evidence, "domain", "domains"), "project_id", "left").join(counted(findings.withColumn("severity", F.lower("severity")), "severity", "findings"), "project_id", "left")
    out = out.join(gravest, "project_id", "left").join(counted(decisions, "decision", "n_by_decision"), "project_id", "left")
    out = out.withColumn("decision", F.coalesce("decision", F.lit("ACCEPT"))).fillna(0, ["n_assets", "n_evidence", "n_detection", "n_proof", "n_policy"])
    names = sorted(out.columns)
    return out.withColumn("content_hash", F.sha2(F.to_json(F.struct(*names)), 256))


def markdown(df: DataFrame, title: str, rows: int = 1000) -> str:
    """A table for readers; beyond rows rows the last line says how many more there are (write_json has all)."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "-|" * len(df.columns)
    shown = df.limit(rows + 1).collect()
    lines = ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in shown[:rows]]
    if len(shown) > rows:
        lines.append(f"\n{df.count() - rows} more rows aren't shown.")
    return "\n".join([f"# {title}", "", head, *lines, ""])


def write_json(df: DataFrame, path: str, keys: list[str]) -> None:
    """Sorted rows as JSON lines, keys in order: equal tables give equal files."""
    df.select(*sorted(df.columns)).orderBy(*keys).write.mode("overwrite").json(path)
