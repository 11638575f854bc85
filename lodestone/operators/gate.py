"""A trained gate: a multinomial model of classes, with refusals set on rows it hasn't seen.

The model has the smoothed log probability of each term in each class. A text's class is the one that makes its known
terms likeliest. Two figures say how far that can be trusted: `margin`, by how much a term on average speaks for the
best class against the next, and `fit`, the mean log probability of a term under the best class, an unknown one counting
as the rarest. A text is refused that has a lower margin than the least at which, on the calibration rows, the wanted
share of accepted texts was right; or a lower fit than all but a small share of these rows had: it is of another domain.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import listed, terms
from lodestone.session import kept


class Gate(NamedTuple):
    terms: DataFrame  # term, class, log_p; classes that lack a term have `unseen`
    classes: DataFrame  # class, prior, unseen: as many rows as classes
    least_margin: float
    least_fit: float


def _counts(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    return listed(rows, terms(F.col(text)), "term", *keys).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def scored(gate: Gate, rows: DataFrame, row_id: str = "query_id", text: str = "text") -> DataFrame:
    """row_id, class, margin, fit of each text; a text without terms has no class, margin 0 and the least fit there is."""
    counts = _counts(rows.select(F.col(row_id).alias("id"), F.col(text).alias("text")), "text", "id")
    every = counts.crossJoin(F.broadcast(gate.classes))  # as many rows as classes
    parts = every.join(gate.terms, ["term", "class"], "left").groupBy("id", "class", "prior").agg(F.sum(F.col("tf") * F.coalesce("log_p", "unseen")).alias("sum"), F.sum("tf").alias("n"))
    total = F.col("prior") + F.col("sum")
    order = Window.partitionBy("id").orderBy(F.col("total").desc(), "class")
    ranked = parts.select("id", "class", "sum", "n", total.alias("total")).withColumns({"k": F.row_number().over(order), "next": F.lead("total").over(order)})
    best = ranked.filter("k = 1").select("id", "class", F.round(F.coalesce((F.col("total") - F.col("next")) / F.col("n"), F.lit(0.0)), 9).alias("margin"), F.round(F.col("sum") / F.col("n"), 9).alias("fit"))
    found = rows.select(F.col(row_id).alias("id")).join(best, "id", "left")
    return found.select(F.col("id").alias(row_id), "class", F.coalesce("margin", F.lit(0.0)).alias("margin"), F.coalesce("fit", F.lit(float("-inf"))).alias("fit"))


def fit(rows: DataFrame, right: float = 0.95, strange: float = 0.01, row_id: str = "id", text: str = "text", label: str = "class", smoothing: float = 0.1) -> Gate:
    """A gate from labelled rows: four fifths by the hash of the id teach the model, the others set the limits. `right`
    is the share of accepted texts whose class should be right, `strange` the share of known texts that may be refused
    as strange. Without a limit that reaches `right`, the one with the highest share is taken."""
    given = rows.filter(F.col(label).isNotNull()).select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.col(label).alias("class"))
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    taught = given.filter(~held)
    counts = kept(_counts(taught, "text", "class"))
    sizes = counts.groupBy("class").agg(F.sum("tf").alias("n"))
    n_terms = counts.select("term").distinct().count()
    docs = taught.groupBy("class").agg(F.count(F.lit(1)).alias("docs"))
    share = F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy()))  # a row a class
    bottom = F.col("n") + smoothing * (n_terms + 1)
    classes = kept(docs.join(sizes, "class").select("class", share.alias("prior"), F.log(smoothing / bottom).alias("unseen"), "n"))
    log_p = counts.join(F.broadcast(classes.select("class", "n")), "class").select("term", "class", F.log((F.col("tf") + smoothing) / bottom).alias("log_p"))
    gate = Gate(kept(log_p), classes.drop("n"), 0.0, float("-inf"))
    judged = kept(scored(gate, given.filter(held), "id").join(given.select("id", F.col("class").alias("true")), "id"))
    # in a thousand steps of the margin, so that the driver gets as many rows however many are judged
    step = F.floor(F.least(F.col("margin"), F.lit(10.0)) * 100).cast("long")
    steps = judged.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") == F.col("true")).alias("ok")).orderBy(F.col("step").desc()).collect()
    accepted = correct = 0
    best, least = (-1.0, 0), 0.0
    for s in steps:
        accepted, correct = accepted + s["n"], correct + s["ok"]
        reached = correct / accepted
        if (min(reached, right), accepted) > best:
            best, least = (min(reached, right), accepted), s["step"] / 100
    fits = judged.filter(F.col("fit") > float("-inf")).agg(F.percentile_approx("fit", strange, 10_000).alias("fit")).first()["fit"]
    return gate._replace(least_margin=least, least_fit=float("-inf") if fits is None else fits)


def judge(gate: Gate, rows: DataFrame, row_id: str = "query_id", text: str = "text") -> DataFrame:
    """row_id, class, margin, fit, refused, why ('no terms', 'strange', 'unsure' or null)."""
    found = scored(gate, rows, row_id, text)
    why = F.when(F.col("class").isNull(), "no terms").when(F.col("fit") < gate.least_fit, "strange").when(F.col("margin") < gate.least_margin, "unsure")
    return found.withColumn("why", why).withColumn("refused", F.col("why").isNotNull()).select(row_id, "class", "margin", "fit", "refused", "why")
