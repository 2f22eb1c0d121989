"""Canonical JSON of any payload: keys sorted, no spaces, characters outside ASCII escaped, numbers as Python writes them.

A payload is taken apart as VARIANT, level by level: every node has the path that leads to it. Put in order of paths, the nodes of a payload are its
canonical text from left to right, brackets included, so it is rebuilt by one sort of its own nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 16
_STEP = "struct<last:int,key:string,pos:int>"


def escaped(x: Column) -> Column:
    """A JSON string literal with characters outside ASCII escaped."""
    raw = F.to_json(F.struct(x.alias("x")))
    body = F.substr(raw, F.lit(6), F.length(raw) - 6)
    odd = F.transform(F.split(body, ""), lambda c: F.when((F.octet_length(c) > 1) | (c == "\x7f"), _units(c)).otherwise(c))
    return F.when(F.octet_length(body) == F.length(body), body).otherwise(F.array_join(odd, ""))


def _units(c: Column) -> Column:
    u = F.lower(F.hex(F.encode(c, "UTF-16BE")))
    return F.when(c == "\x7f", c).otherwise(F.concat(F.lit("\\u"), F.substring(u, 1, 4), F.when(F.length(u) > 4, F.concat(F.lit("\\u"), F.substring(u, 5, 4))).otherwise("")))


def float_text(x: Column) -> Column:
    """A double in the fewest digits that mean it (subnormal ones in the JVM's): plain from a ten-thousandth up to 10 to the 16th, else with an exponent of two digits or more."""
    size = F.abs(x)
    short = [F.format_string(f"%.{n - 1}e", size) for n in (15, 16, 17)]  # the JVM's own digits are often more than are needed
    s = F.translate(F.coalesce(*(F.when(c.try_cast("double") == size, c) for c in short), size.cast("string")), "E", "e")
    mantissa, power = F.substring_index(s, "e", 1), F.when(F.contains(s, F.lit("e")), F.substring_index(s, "e", -1).cast("int")).otherwise(0)
    whole, part = F.substring_index(mantissa, ".", 1), F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise("")
    every = F.concat(whole, part)
    digits = F.regexp_replace(F.regexp_replace(every, "^0+", ""), "0+$", "")
    lead = F.length(every) - F.length(F.regexp_replace(every, "^0+", ""))
    e = power + F.length(whole) - 1 - lead  # of the first digit
    n = F.length(digits)
    tail = F.substring(digits, 2, 40)
    plain = F.when(e >= n - 1, F.concat(F.rpad(digits, e + 1, "0"), F.lit(".0"))).when(e >= 0, F.concat(F.left(digits, e + 1), F.lit("."), F.substr(digits, e + 2))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
    power_text = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), "0"))
    small = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), tail)).otherwise(""), power_text)
    text = F.when(digits == "", "0.0").when((e >= -4) & (e < 16), plain).otherwise(small)
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity")).otherwise(F.concat(F.when((x < 0) | (x.cast("string").startswith("-")), "-").otherwise(""), text))


def _scalar(v: Column, kind: Column) -> Column:
    number = F.when(kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT)$"), F.try_variant_get(v, "$", "string")).when(kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), F.try_variant_get(v, "$", "string")).otherwise(float_text(F.try_variant_get(v, "$", "double")))
    return F.when(kind == "STRING", escaped(F.try_variant_get(v, "$", "string"))).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "string")).when(kind == "VOID", "null").otherwise(number)


def canonical(rows: DataFrame, key: str, payload: str, levels: int = LEVELS) -> DataFrame:
    """``key`` and the ``canonical`` text of the JSON in the column ``payload`` of each row (one row a key); null where it is no JSON.

    More than ``levels`` levels of nesting are an error.
    """
    kind = F.schema_of_variant("v")
    at = rows.select(F.col(key).alias("key"), F.array().cast(f"array<{_STEP}>").alias("path"), F.try_parse_json(payload).alias("v"))
    parts = []
    for level in range(levels + 1):
        node = at.select("key", "path", "v", F.when(F.col("v").isNull(), F.lit("none")).otherwise(kind).alias("kind"))
        node = node.withColumn("shape", F.when(F.col("kind").startswith("OBJECT"), "{").when(F.col("kind").startswith("ARRAY"), "[").otherwise(""))
        name = F.when(F.size("path") == 0, "").when(F.element_at("path", -1)["pos"] >= 0, "").otherwise(F.concat(escaped(F.element_at("path", -1)["key"]), F.lit(":")))
        deep = F.when((F.col("shape") != "") & F.lit(level == levels), F.raise_error(F.lit(f"payload of more than {levels} levels")).cast("string"))
        own = F.coalesce(deep, F.concat(name, F.when(F.col("shape") != "", F.col("shape")).when(F.col("kind") == "none", F.lit(None)).otherwise(_scalar(F.col("v"), F.col("kind")))))
        last = F.concat("path", F.array(F.struct(F.lit(1).alias("last"), F.lit("").alias("key"), F.lit(0).alias("pos")).cast(_STEP)))
        end = F.when(F.col("shape") == "{", "}").when(F.col("shape") == "[", "]")
        parts.append(node.select("key", "path", own.alias("token"), F.when(F.col("shape") != "", "open").otherwise("leaf").alias("role")))
        parts.append(node.filter("shape <> ''").select("key", last.alias("path"), end.alias("token"), F.lit("close").alias("role")))
        if level < levels:
            at = node.filter("shape <> ''").sparkSession.sql(
                "SELECT n.key, concat(n.path, array(CAST(named_struct('last', 0, 'key', coalesce(c.key, ''), 'pos', CASE WHEN c.key IS NULL THEN c.pos ELSE -1 END) AS struct<last:int,key:string,pos:int>))) AS path, c.value AS v FROM {n} AS n, LATERAL variant_explode(n.v) AS c",
                n=node.filter("shape <> ''"),
            )
    every = reduce(DataFrame.unionByName, parts)
    nodes = every.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("path", "token", "role"))).alias("n"))  # of one payload
    comma = lambda i: F.when((F.get("n", i - 1)["role"] == "open") | (F.get("n", i)["role"] == "close") | (i == 0), "").otherwise(",")
    text = F.array_join(F.transform("n", lambda x, i: F.concat(comma(i), x["token"])), "")
    return nodes.select(F.col("key").alias(key), F.when(F.get("n", F.lit(0))["token"].isNotNull(), text).alias("canonical"))
