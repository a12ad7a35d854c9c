"""The gate that candidates pass: a chain of checks as one Column expression."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar


@dataclass(frozen=True)
class Gate:
    """Thresholds of one rule; a disabled gate only rejects placeholders."""

    enabled: bool = True
    min_entropy: float = 3.5
    min_normalized: float = 0.55
    min_length: int = 16
    max_length: int = 4096
    min_charset_coverage: float = 0.45
    max_repeat_run: int = 5
    max_sequential_run: int = 6
    max_word_likeness: float = 0.62
    reject_encoded_text: bool = True
    reject_placeholders: bool = True
    reject_uuid: bool = True
    charsets: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def structural(cls) -> Gate:
        return cls(enabled=False, min_length=0)

    @classmethod
    def from_mapping(cls, given: dict | None, base: Gate | None = None) -> Gate:
        base = base or cls()
        given = dict(given or {})
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown entropy fields: {sorted(unknown)}")
        if "charsets" in given:
            names = given["charsets"] or ()
            given["charsets"] = frozenset([names] if isinstance(names, str) else names)
        return replace(base, **given)

    def as_mapping(self) -> dict:
        return {f.name: sorted(self.charsets) if f.name == "charsets" else getattr(self, f.name) for f in fields(self)}

    def as_row(self) -> tuple:
        """The fields' values in order, thresholds as floats."""
        thresholds = ("min_entropy", "min_normalized", "min_charset_coverage", "max_word_likeness")
        values = self.as_mapping()
        return tuple(float(v) if k in thresholds else v for k, v in values.items())

    def as_struct(self) -> Column:
        names = [F.lit(x) for x in sorted(self.charsets)]
        parts = {f.name: F.lit(getattr(self, f.name)) for f in fields(self) if f.name != "charsets"}
        for name in ("min_entropy", "min_normalized", "min_charset_coverage", "max_word_likeness"):
            parts[name] = F.lit(float(getattr(self, name)))
        return F.struct(*[c.alias(n) for n, c in parts.items()], F.array(*names).cast("array<string>").alias("charsets"))


def strip_value(value: Column) -> Column:
    """Without white space, and then quotes, commas and semicolons, at both ends."""
    return F.regexp_replace(F.regexp_replace(value, r"\A\s+|\s+\z", ""), "\\A[\"'`,;]+|[\"'`,;]+\\z", "")


def two_digits(x: Column) -> Column:
    return F.format_string("%.2f", F.bround(x, 2))


#: Columns that ``judge`` adds.
VERDICT = ("reason", "entropy", "normalized", "charset", "delta", "evidence")


def judge(candidates, value: Column, gate: Column):
    """``candidates`` with the verdict on ``value`` under ``gate`` (a struct of a Gate's fields).

    ``reason`` is why a candidate is rejected, null if it is accepted; then ``delta``
    adds to its confidence and ``evidence`` says why.  The order of the checks is fixed.
    """
    v = F.col("_value")
    g = gate
    out = candidates.withColumn("_value", strip_value(value))
    out = out.withColumn("charset", F.when(F.length(v) > 0, scalar.detect_charset(v)).otherwise("printable")).withColumn("entropy", scalar.shannon_entropy(v))
    out = out.withColumn("_most", F.log2(scalar.charset_size(F.col("charset")))).withColumn("normalized", F.col("entropy") / F.col("_most"))
    out = out.withColumns({
        "_coverage": scalar.charset_coverage(v, F.col("charset")),
        "_repeat": scalar.longest_repeat_run(v),
        "_sequence": scalar.longest_sequential_run(v),
        "_wordish": F.when(F.col("charset").isin("hex", "base32"), F.lit(0.0)).otherwise(scalar.word_likeness(v)),
    })
    entropy, normalized, charset = F.col("entropy"), F.col("normalized"), F.col("charset")
    says = lambda name, *parts: F.concat(F.lit(f"{name}("), *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(")"))
    number = lambda x: F.regexp_replace(x.cast("string"), r"\A\.", "0.")
    reason = (
        F.when(g["reject_placeholders"] & scalar.has_placeholder(v), F.lit("placeholder-or-doc-example"))
        .when(~g["enabled"], F.lit(None).cast("string"))
        .when(F.length(v) < g["min_length"], says("too-short", "<", g["min_length"].cast("string")))
        .when(F.length(v) > g["max_length"], says("too-long", ">", g["max_length"].cast("string")))
        .when((F.size(g["charsets"]) > 0) & ~F.array_contains(g["charsets"], charset), says("charset-not-allowed", charset))
        .when(g["reject_uuid"] & v.rlike(scalar.UUID), F.lit("uuid-shape"))
        .when(v.rlike(scalar.TIMESTAMP), F.lit("timestamp-shape"))
        .when(v.rlike(scalar.NUMERIC), F.lit("numeric-only"))
        .when(F.col("_coverage") < g["min_charset_coverage"], says("low-charset-coverage", two_digits(F.col("_coverage"))))
        .when(F.col("_repeat") > g["max_repeat_run"], says("repeated-run", F.col("_repeat").cast("string")))
        .when(F.col("_sequence") > g["max_sequential_run"], says("sequential-run", F.col("_sequence").cast("string")))
        .when(F.col("_wordish") > g["max_word_likeness"], says("natural-language-like", two_digits(F.col("_wordish"))))
        .when(g["reject_encoded_text"] & scalar.looks_like_encoded_text(v), F.lit("base64-decodes-to-text"))
        .when(entropy < g["min_entropy"], says("entropy-below-threshold", two_digits(entropy), "<", number(g["min_entropy"])))
        .when(normalized < g["min_normalized"], says("normalized-entropy-below-threshold", two_digits(normalized), "<", number(g["min_normalized"])))
    )
    room = (normalized - g["min_normalized"]) / F.greatest(F.lit(1e-9), 1 - g["min_normalized"])
    delta = F.round(F.least(F.greatest(room, F.lit(0.0)), F.lit(1.0)) * 0.4 - 0.05, 4) + F.when(F.length(v) >= 40, 0.05).otherwise(0.0)
    facts = F.concat(
        F.array(F.concat(F.lit("entropy="), two_digits(entropy), F.lit("/"), two_digits(F.col("_most")), F.lit("("), charset, F.lit(")")), F.concat(F.lit("charset_coverage="), two_digits(F.col("_coverage")))),
        F.when(F.col("_wordish") <= 0.2, F.array(F.lit("non-linguistic"))).otherwise(F.array().cast("array<string>")),
    )
    out = out.withColumn("reason", reason)
    accepted = F.col("reason").isNull()
    out = out.withColumn("delta", F.when(~accepted, F.lit(-1.0)).when(~g["enabled"], F.lit(0.15)).otherwise(F.round(F.least(delta, F.lit(0.45)), 4)))
    out = out.withColumn("evidence", F.when(~accepted, F.array("reason")).when(~g["enabled"], F.array(F.lit("structural-match"))).otherwise(facts))
    return out.drop("_value", "_most", "_coverage", "_repeat", "_sequence", "_wordish")
