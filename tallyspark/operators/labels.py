"""Figures and the labels nearest to them, as joins of places.

Figures, labels, line feeds, colons and ends of clauses of a document are one stream in order of place. Windows over that stream give each figure how far it
may look, and the labels there on both sides; the nearest label of the figure's unit is its metric. A label behind a figure that is
nearer to it than to the next one belongs to it, and isn't looked at again: that depends on order, and is a fold over a document's figures.

``documents`` have tenant_id, document_id (one row each) and text; ``phrases`` have phrase (lower case), metric, unit and place (order of preference), and tenant_id
where they hold for one tenant alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import marks
from ..sources.releases import FIGURE
from .staging import settled

KEYS = ["tenant_id", "document_id"]
#: Characters that a figure looks back and ahead.
BACK, AHEAD = 90, 60
FEW = 64  # keywords of a tenant that each of its texts is held against one by one
CLAUSE = r"(?i)[.,;:\n]|\b(?:and|but|while|which|whereas)\b"
_LABEL = "struct<start:int,end:int,metric:string,unit:string,place:int>"


def figure_spans(documents: DataFrame) -> DataFrame:
    """Every figure of each document: ``figure`` (as written), ``start``, ``end`` (code points)."""
    found = marks.matches(documents, KEYS, "text", FIGURE)
    return found.select(*KEYS, F.regexp_replace("found", r"(?U)^\s+|\s+$", "").alias("figure"), "start", "end")


def phrases_of(metrics: DataFrame, aliases: DataFrame) -> DataFrame:
    """The phrases of all metrics with their labels; earlier registered metrics come first."""
    every = aliases.select("metric", F.lower("phrase").alias("phrase")).union(metrics.select("id", F.lower("label"))).distinct()
    return every.join(metrics.select(F.col("id").alias("metric"), "unit", F.col("position").cast("int").alias("place")), "metric")


def _pattern(*by: str):
    """Of phrases: the pattern that finds the longest at each place, by the columns named.

    What begins at one place begins with one character, so phrases stand behind their first one, and a place tries the few that it may begin.
    """
    first = F.substring("phrase", 1, 1)
    longest = F.array_sort(F.collect_set(F.struct((-F.length("phrase")).alias("n"), F.substring(F.col("phrase"), F.lit(2), F.length("phrase")).alias("rest"))))
    rests = F.array_join(F.transform(longest, lambda p: marks.literal(p["rest"])), "|")
    branch = F.concat(marks.literal(F.min(first)), F.lit("(?:"), rests, F.lit(")")).alias("branch")

    def of(phrases: DataFrame) -> DataFrame:
        branches = phrases.filter("phrase <> ''").groupBy(*by, F.lower(F.upper(first)).alias("head")).agg(branch)  # as patterns compare without case
        return branches.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("branch")), "|").alias("pattern"))

    return of


def label_spans(documents: DataFrame, phrases: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Every place of every phrase, one inside of another too: ``start``, ``end``, ``metric``, ``unit`` and ``place``.

    ``own`` are phrases with a tenant_id, for that tenant's documents alone: all tenants' are looked for in one plan, each document by its tenant's pattern.
    """

    def found(texts: DataFrame, listed: DataFrame, by: list[str]) -> DataFrame:
        at = marks.starts(texts, KEYS, "text", F.concat(F.lit("(?iu)"), F.col("pattern")))
        longest = F.lower("found")
        each = at.select(*KEYS, "start", F.explode(F.transform(F.sequence(F.lit(1), F.length("found")), lambda n: F.substring(longest, F.lit(1), n))).alias("phrase"))  # what else begins there is a prefix
        return each.join(listed, [*by, "phrase"]).select(*KEYS, "start", (F.col("start") + F.length("phrase")).alias("end"), "metric", "unit", "place")

    out = found(documents.withColumn("pattern", _pattern()(phrases).scalar()), phrases, [])
    if own is not None:
        out = out.unionByName(found(documents.join(_pattern("tenant_id")(own), "tenant_id"), own, ["tenant_id"])).distinct()
    return out


def _unit(figure: Column) -> Column:
    return F.when(F.contains(figure, F.lit("%")), "percent").when(figure.rlike("(?i)bps|basis points"), "basis_points").otherwise("currency")


def nearest_labels(documents: DataFrame, phrases: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``figure``, ``start``, ``end``, ``unit`` of each figure with the ``metric`` of the nearest label, null where there is none in reach.

    Nearness comes first, then labels before the figure, longer ones, and earlier registered metrics. A figure looks back ``BACK`` characters but not beyond the start of a
    line with a colon, and ahead ``AHEAD`` but not beyond the end of its clause or the next figure.
    """
    # Patterns are the work, and a file of short texts is few tasks; places then stay with their document. A number is named: what is small in bytes would be put together again.
    documents = documents.select(*KEYS, "text").repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS)
    length = documents.select(*KEYS, F.length(F.coalesce("text", F.lit(""))).alias("size"))
    in_order = Window.partitionBy(*KEYS).orderBy("start")
    figs = figure_spans(documents).join(length, KEYS).withColumn("until", F.lead("start").over(in_order)).withColumn("unit", _unit(F.col("figure")))
    fig = F.struct("start", "end", "figure", "unit", "until", "size")
    labels = label_spans(documents, phrases, own)
    label = F.struct("start", "end", "metric", "unit", "place").cast(_LABEL)
    no_fig, no_label = F.lit(None).cast(figs.select(fig.alias("f")).schema["f"].dataType), F.lit(None).cast(_LABEL)
    at = lambda pos, kind, lb=no_label: F.struct(F.col(pos).cast("int").alias("pos"), F.lit(kind).alias("kind"), lb.alias("lb"))
    rows = lambda df, f, *ats: df.select(*KEYS, f.alias("f"), F.explode(F.array_compact(F.array(*ats))).alias("at")).select(*KEYS, "at.pos", "at.kind", "f", "at.lb")  # noqa: E731  (places are searched for once)
    line = F.struct(F.col("start"), F.col("end"), F.col("found").alias("metric"), F.lit("").alias("unit"), F.lit(0).alias("place")).cast(_LABEL)
    cuts = marks.starts(documents, KEYS, "text", CLAUSE)
    stream = rows(figs, fig, at("start", "from"), at("end", "to")).unionByName(rows(labels, no_fig, at("end", "before", label), at("start", "after", label)))
    stream = stream.unionByName(rows(cuts, no_fig, at("start", "cut"), F.when(F.col("found").isin("\n", ":"), at("start", "line", line))))
    place = Window.partitionBy(*KEYS).orderBy("pos")
    back, ahead = place.rangeBetween(-BACK - 1, 0), place.rangeBetween(0, AHEAD)
    last = lambda sign: F.max(F.when((F.col("kind") == "line") & (F.col("lb.metric") == sign), F.col("pos"))).over(back)
    listed = lambda kind, frame: F.collect_list(F.when(F.col("kind") == kind, F.col("lb"))).over(frame)  # noqa: E731  (what lies in reach)
    seen = stream.withColumn("feed", last("\n")).withColumn("colon", last(":")).withColumn("stop", F.min(F.when(F.col("kind") == "cut", F.col("pos"))).over(ahead))
    seen = seen.withColumn("before", listed("before", back)).withColumn("after", listed("after", ahead)).filter(F.col("kind").isin("from", "to"))
    if_from = lambda c: F.max(F.when(F.col("kind") == "from", F.col(c)))
    if_to = lambda c: F.max(F.when(F.col("kind") == "to", F.col(c)))
    one = seen.groupBy(*KEYS, F.col("f.start").alias("start")).agg(F.max("f").alias("f"), if_from("feed").alias("feed"), if_from("colon").alias("colon"), if_to("stop").alias("stop"), if_from("before").alias("before"), if_to("after").alias("after"))
    lo = F.greatest(F.lit(0), F.col("start") - BACK, F.when(F.col("colon") > F.col("feed"), F.col("feed") + 1).otherwise(0))
    hi = F.least(F.col("stop"), F.col("f.end") + AHEAD, F.coalesce("f.until", "f.size"))
    one = one.withColumn("lo", lo).withColumn("hi", hi)
    one = one.withColumn("before", F.filter("before", lambda m: (m["unit"] == F.col("f.unit")) & (m["start"] >= F.col("lo")) & (m["end"] <= F.col("start"))))
    one = one.withColumn("after", F.filter("after", lambda m: (m["unit"] == F.col("f.unit")) & (m["start"] >= F.col("f.end")) & (m["end"] <= F.col("hi"))))
    scored = lambda side, gap: F.transform(side, lambda m: F.struct(gap(m).alias("gap"), F.lit(int(side == "after")).alias("side"), (m["start"] - m["end"]).alias("n"), m["place"].alias("place"), m["metric"].alias("metric"), m["start"].alias("start"), m["end"].alias("end")))
    one = one.withColumn("near", F.concat(scored("before", lambda m: F.col("start") - m["end"]), scored("after", lambda m: m["start"] - F.col("f.end"))))
    return _settled(one.select(*KEYS, "f", "near"))


def _settled(rows: DataFrame) -> DataFrame:
    """The fold: figures of a document from the first on, with the labels that are taken (only those in reach are kept)."""
    doc = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col("f.start").alias("at"), "f", "near"))).alias("figures"))  # a document's own
    used = "array<struct<start:int,end:int>>"
    done = "array<struct<start:int,end:int,figure:string,unit:string,metric:string>>"
    kind = f"struct<used:{used},done:{done}>"

    def step(s: Column, x: Column) -> Column:
        f, taken = x["f"], s["used"]
        free = F.filter(x["near"], lambda m: (m["side"] == 1) | ~F.exists(taken, lambda u: (m["start"] < u["end"]) & (u["start"] < m["end"])))
        best = F.array_min(free)
        own = (best["side"] == 1) & (best["start"] - f["end"] <= F.coalesce(f["until"], f["size"]) - best["end"])
        kept = F.filter(taken, lambda u: u["end"] > f["end"] - BACK - 1)
        now = F.when(F.coalesce(own, F.lit(False)), F.concat(kept, F.array(F.struct(best["start"].alias("start"), best["end"].alias("end"))).cast(used))).otherwise(kept)
        row = F.struct(f["start"].alias("start"), f["end"].alias("end"), f["figure"].alias("figure"), f["unit"].alias("unit"), best["metric"].alias("metric"))
        return F.struct(now.cast(used).alias("used"), F.concat(s["done"], F.array(row).cast(done)).alias("done")).cast(kind)

    start = F.struct(F.array().cast(used).alias("used"), F.array().cast(done).alias("done")).cast(kind)
    return doc.select(*KEYS, F.explode(F.aggregate("figures", start, step)["done"]).alias("c")).select(*KEYS, "c.*")


def named_keywords(texts: DataFrame, keywords: DataFrame, few: int = FEW) -> DataFrame:
    """Keywords (tenant_id, keyword) that lie in a tenant's texts (tenant_id, document_id, low), wherever: one row for each text and keyword.

    A tenant's ``few`` keywords or less go with its texts as one list, and each text is held against it where it stands. What has more goes by an index.
    """
    known = settled(keywords.select("tenant_id", "keyword").distinct().filter("keyword <> ''"), "keywords")
    count = known.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    short = count.filter(F.col("n") <= few).select("tenant_id")
    lists = settled(known.join(short, "tenant_id", "left_semi").groupBy("tenant_id").agg(F.collect_list("keyword").alias("known")), "lists")  # at most ``few`` each
    named = texts.join(lists, "tenant_id").select("tenant_id", "document_id", F.explode(F.filter("known", lambda k: F.contains("low", k))).alias("keyword"))
    rest = settled(known.join(short, "tenant_id", "left_anti"), "rest")
    return named if rest.isEmpty() else named.unionByName(_indexed_keywords(texts, rest))


def _indexed_keywords(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``named_keywords`` by an inverted index, for tenants with any number of them.

    Each text gives its distinct runs of up to three characters, each keyword the rarest of its own in the tenant's texts. They meet in an equi-join
    on that run, and what meets is held against the text. Rows grow with the places of rare runs, not with texts times keywords.
    """
    size = 3
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    runs = lambda c, n: F.transform(c, lambda x, i: F.array_join(F.slice(c, i + 1, n), ""))
    own = known.withColumn("c", chars("keyword")).withColumn("w", F.least(F.lit(size), F.size("c")))
    own = own.select("tenant_id", "keyword", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("c") - F.col("w") + 1), lambda i: F.array_join(F.slice("c", i, F.col("w")), "")))).alias("run"))
    wanted = own.select("tenant_id", F.length("run").alias("n")).distinct().groupBy("tenant_id").agg(F.collect_set("n").alias("sizes"))  # at most three
    split = texts.join(wanted, "tenant_id").withColumn("c", chars("low"))
    index = split.select("tenant_id", "document_id", F.explode(F.array_distinct(F.flatten(F.transform("sizes", lambda n: runs(F.col("c"), n))))).alias("run"))
    index = index.join(own.select("tenant_id", "run").distinct(), ["tenant_id", "run"], "left_semi")
    often = index.groupBy("tenant_id", "run").agg(F.count(F.lit(1)).alias("texts"))
    rarest = own.join(often, ["tenant_id", "run"], "left").groupBy("tenant_id", "keyword").agg(F.min_by("run", F.struct(F.coalesce("texts", F.lit(0)), "run")).alias("run"))
    met = index.join(rarest, ["tenant_id", "run"]).select("tenant_id", "document_id", "keyword")
    return met.join(texts.select("tenant_id", "document_id", "low"), ["tenant_id", "document_id"]).filter(F.contains("low", F.col("keyword"))).select("tenant_id", "document_id", "keyword")
