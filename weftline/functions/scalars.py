"""Scalar functions as Column expressions: truth, text, identity, versions, pauses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are false, after trimming and in lower case.
FALSE_TEXTS = ("", "0", "false", "no", "off", "null")
WHITE = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: How a pause's text begins; a host that shares its claims with another runner gives that one's in its place.
PAUSE = "weftline:pause:"
OLD_PAUSES = {"awaiting-approval:": "approval", "awaiting-input:": "input"}  # fixed values: prefixes of old


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def truthy_text(text: Column) -> Column:
    return F.coalesce(~F.lower(trimmed(text)).isin(*FALSE_TEXTS), F.lit(False))


def number_text(number: Column) -> Column:
    """A double without exponent and without a fraction that is zero: 3, 0.1, 1000000000000000000000."""
    plain = number.cast("string")
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^-?([\d.]+)E", 1), r"\.0$", "")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    exponent = F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int")
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    large = F.concat(sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(400)))
    return (
        F.when(F.isnan(number), F.lit("NaN"))
        .when(number == float("inf"), F.lit("inf"))
        .when(number == float("-inf"), F.lit("-inf"))
        .when(number == 0, F.lit("0"))
        .when(number == F.rint(number), F.format_string("%.0f", number))
        .when(plain.contains("E-"), small)
        .when(plain.contains("E"), large)
        .otherwise(plain)
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z'-]+"))


def escape_segment(text: Column) -> Column:
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("/"), F.lit("%2F")), F.lit("#"), F.lit("%23"))


def step_key(run_key: Column, node_id: Column, path: Column | None = None, occurrence: Column | None = None) -> Column:
    """run_key:segment/segment/node#occurrence; path is an array of text segments, occurrence null if there is none."""
    parts = F.array(escape_segment(node_id)) if path is None else F.concat(F.transform(F.coalesce(path, F.array().cast("array<string>")), escape_segment), F.array(escape_segment(node_id)))
    key = F.concat(run_key, F.lit(":"), F.array_join(parts, "/"))
    return key if occurrence is None else F.concat(key, F.coalesce(F.concat(F.lit("#"), occurrence.cast("string")), F.lit("")))


def is_replay_safe(attempt: Column, first_attempt_at: Column, now: Column, window_s: Column) -> Column:
    """Times in milliseconds. A first attempt is safe, and any is without a window."""
    return F.when((attempt <= 1) | window_s.isNull(), True).when(window_s <= 0, False).otherwise(now - first_attempt_at <= window_s * 1000)


def _number(text: Column, part: int) -> Column:
    return F.regexp_extract(text, r"^\s*v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", part)


def satisfies_range(version: Column, spec: Column) -> Column:
    """Whether a version lies in a range: clauses parted by ||, each with at most one of >= <= > < ^ ~ =.

    A version needs major and minor; a clause may leave off minor and patch. Before 1.0 a caret holds the
    minor too. What follows a clause's digits is not looked at.
    """
    def triple(text: Column) -> Column:
        return F.struct(*(F.coalesce(F.nullif(_number(text, i), F.lit("")).cast("bigint"), F.lit(0)).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))))

    v = triple(version)
    known = version.rlike(r"^\s*v?\d+\.\d+")

    def clause(c: Column) -> Column:
        c = F.trim(c)
        op = F.regexp_extract(c, r"^(>=|<=|>|<|\^|~|=)?", 1)
        rest = F.trim(F.regexp_replace(c, r"^(>=|<=|>|<|\^|~|=)", ""))
        w = triple(rest)
        caret = (v >= w) & (v["a"] == w["a"]) & ((w["a"] > 0) | (v["b"] == w["b"]))
        tilde = (v >= w) & (v["a"] == w["a"]) & (v["b"] == w["b"])
        tested = F.when(op == ">=", v >= w).when(op == "<=", v <= w).when(op == ">", v > w).when(op == "<", v < w).when(op == "^", caret).when(op == "~", tilde).otherwise(v == w)
        return F.when(c.isin("", "*"), F.lit(True)).otherwise(known & rest.rlike(r"^v?\d") & tested)

    return F.coalesce(F.exists(F.split(spec, r"\|\|"), clause), F.lit(False))


def is_pause(reason: Column, prefix: str = PAUSE) -> Column:
    out = reason.startswith(prefix)
    for prefix in OLD_PAUSES:
        out = out | reason.startswith(prefix)
    return out


def decoded_pause(reason: Column, prefix: str = PAUSE) -> Column:
    """(node_id, awaiting, detail) of a pause's text; null for any other text, a broken pause too. detail is JSON or null."""
    body = F.from_json(F.substring(reason, F.lit(len(prefix) + 1), F.length(reason)), "nodeId string, awaiting string, detail string")
    made = F.when(body["nodeId"].isNotNull() & body["awaiting"].isNotNull(), F.struct(body["nodeId"].alias("node_id"), body["awaiting"].alias("awaiting"), body["detail"].alias("detail")))
    out = F.when(reason.startswith(prefix), made)
    for prefix, awaiting in OLD_PAUSES.items():
        old = F.struct(F.substring(reason, F.lit(len(prefix) + 1), F.length(reason)).alias("node_id"), F.lit(awaiting).alias("awaiting"), F.lit(None).cast("string").alias("detail"))
        out = out.when(reason.startswith(prefix), old)
    return out


def encoded_pause(node_id: Column, awaiting: Column, detail: Column | None = None, prefix: str = PAUSE) -> Column:
    parts = [node_id.alias("nodeId"), awaiting.alias("awaiting")]
    text = F.to_json(F.struct(*parts))
    if detail is None:
        return F.concat(F.lit(prefix), text)
    with_detail = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"detail":'), detail, F.lit("}"))
    return F.concat(F.lit(prefix), F.when(detail.isNull(), text).otherwise(with_detail))
