"""A stored corpus of articles: arrivals are folded into what is stored, and only into the components that they touch.

Kept are the articles of each component, with all that the rule of identity knows of them; an index from every key that an
arrival ever had (URL, hash, title within a publisher) to a component; and, where components have grown together, a parent
for the one that gave its name up, as in union-find. A load looks its keys up, follows parents to roots, joins roots and
arrivals by the keys that they share, and folds each resulting component: first the articles of its roots, then its
arrivals in order. As components share no key, that equals folding all arrivals ever made, from the start.

The tables are logs: a look-up opens the files that may hold its keys, and a load adds its changes, in one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.sources.log import FILE_ROWS, Log, Shape
from broadsheet.sources.scratch import staged

from . import identity

_ARTICLE = {**dict.fromkeys((*identity.COLUMNS, "content_identity_key", "metadata_json"), "string"), "merged_ids": "array<bigint>", "names": "string"}
SHAPES = {
    "articles": Shape({"component": "bigint", "article_id": "bigint", **_ARTICLE}, ("component", "article_id"), 1),
    "keys": Shape({"key": "string", "component": "bigint"}, ("key",)),
    "parents": Shape({"component": "bigint", "parent": "bigint"}, ("component",)),
    "outcomes": Shape({"arrival_seq": "bigint", "article_id": "bigint", "outcome": "string"}, ("arrival_seq",)),
    "loads": Shape({"name": "string", "last_seq": "bigint"}, ("name",)),
}


class Corpus:
    """A corpus in a folder. Of two loads at once, the second to commit gets a Conflict and can be tried again."""

    def __init__(self, spark: SparkSession, path: str, file_rows: int = FILE_ROWS):
        self.log = Log(spark, path, SHAPES, file_rows)

    def _roots(self, components: DataFrame, number: int) -> DataFrame:
        """(component, root), by following parents until none has one."""
        at = staged(components.select("component", F.col("component").alias("root")).distinct(), "roots")
        while self.log.manifest(number).get("parents"):
            up = self.log.lookup("parents", at.select(F.col("root").alias("component")), number).select(F.col("component").alias("root"), "parent")
            moved = staged(at.join(up, "root", "left").select("component", F.coalesce("parent", "root").alias("root"), F.col("parent").isNotNull().alias("moved")), "roots")
            at = moved.drop("moved")
            if not moved.where("moved").limit(1).count():
                break
        return at

    def load(self, arrivals: DataFrame) -> DataFrame:
        """Folds arrivals (the columns of identity.INPUT) into the corpus; their outcomes: arrival_seq, article_id, outcome.

        Arrivals are numbered after all that came before; a number that isn't is a ValueError, and nothing is stored.
        """
        base = self.log.number()
        rows = staged(identity.shaped(arrivals), "arrivals")
        first, last = rows.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
        before = self.log.read("loads", base).agg(F.max("last_seq")).first()[0]
        if first is None:
            return rows.select("arrival_seq", F.lit(None).cast("long").alias("article_id"), F.lit(None).cast("string").alias("outcome")).limit(0)
        if before is not None and first <= before:
            raise ValueError(f"arrival {first} isn't later than {before}, the last one loaded")
        edges = staged(identity.identity_edges(rows).select("arrival_seq", F.md5("key").alias("key")).distinct(), "edges")
        known = staged(self.log.lookup("keys", edges.select("key"), base), "known")
        roots = self._roots(known.select("component"), base)
        # A root stands for its component among the arrivals: it is the number of an earlier one.
        linked = known.join(roots, "component").select(F.col("root").alias("arrival_seq"), "key")
        old = staged(linked.select("arrival_seq").distinct(), "old")
        placed = staged(identity.label(rows.select("arrival_seq").unionByName(old), edges.unionByName(linked)), "components")
        joined = placed.join(old, "arrival_seq").select(F.col("arrival_seq").alias("root"), "component")
        stored = self.log.lookup("articles", old.select(F.col("arrival_seq").alias("component")), base)
        stored = staged(stored.withColumnRenamed("component", "root").join(joined, "root"), "stored")
        folded = staged(identity.folded(rows.join(placed, "arrival_seq"), stored.drop("root")), "folded")
        outcomes = folded.where("kind = 'arrival'").select("arrival_seq", "article_id", "outcome")
        # All that were followed point straight to where they are now.
        moved = roots.join(joined.withColumnRenamed("component", "parent"), "root").select("component", "parent")
        moved = moved.unionByName(joined.select(F.col("root").alias("component"), F.col("component").alias("parent"))).where("component <> parent").distinct()
        changes = {
            "articles": (folded.where("kind = 'article'").select(*SHAPES["articles"].columns), stored.select(F.col("root").alias("component"), "article_id")),
            "keys": (edges.join(placed, "arrival_seq").select("key", "component").distinct(), None),
            "parents": (moved, None),
            "outcomes": (outcomes, None),
            "loads": (rows.sparkSession.createDataFrame([("last", last)], "name string, last_seq long"), None),
        }
        self.log.append(changes, base)
        return outcomes

    def articles(self) -> DataFrame:
        return self.log.read("articles").drop("component", "names")

    def outcomes(self) -> DataFrame:
        """arrival_seq, article_id, outcome of all arrivals; an article that was merged later counts as the one that has it."""
        number = self.log.number()
        donors = self.log.read("articles", number).select(F.explode("merged_ids").alias("donor"), F.col("article_id").alias("keeper"))
        told = self.log.read("outcomes", number)
        found = told.join(donors, told["article_id"] == donors["donor"], "left")
        return found.select("arrival_seq", F.coalesce("keeper", "article_id").alias("article_id"), "outcome")
