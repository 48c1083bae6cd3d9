"""Connected components of a graph of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) of every document in ``links`` (a, b); comp is the smallest document that links reach.

    Each round takes the smallest label of the neighbours, then the label of that label, so chains shorten fast. Minima
    combine before they shuffle, and each round is a written table, so a lost executor costs that round at most.
    """
    both = stored(
        links.select(F.col("a").alias("doc"), F.col("b").alias("near"))
        .unionByName(links.select(F.col("b").alias("doc"), F.col("a").alias("near")))
        .distinct(),
        "links",
    )
    now = both.groupBy("doc").agg(F.min("near").alias("least")).select("doc", F.least("doc", "least").alias("comp"))
    now = stored(now, "labels")
    while True:
        around = (
            both.join(now.select(F.col("doc").alias("near"), "comp"), "near")
            .groupBy("doc")
            .agg(F.min("comp").alias("around"))
        )
        nearer = now.join(around, "doc").select("doc", "comp", F.least("comp", "around").alias("fresh"))
        step = stored(nearer, "nearer")
        ahead = step.select(F.col("doc").alias("fresh"), F.col("fresh").alias("ahead"))
        jumped = step.join(ahead, "fresh", "left").select(
            "doc", F.least("fresh", F.coalesce("ahead", "fresh")).alias("comp"), F.col("comp").alias("was")
        )
        jumped = stored(jumped, "labels")
        now = jumped.select("doc", "comp")
        if not jumped.filter("comp < was").limit(1).count():
            return now
