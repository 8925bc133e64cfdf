"""What people decided about parties, carried to later rows: keys of narrations, decisions as a memory, its index of
spellings, look-ups by exact, repaired and skeleton keys, and what a hit may replace.

A memory has owner, key, category and confirmed, one row a key of an owner. It may be as large as the rows: nothing is
broadcast by hand, and rows meet it once, by key, after equal keys were looked up together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, narration, text
from .scoping import decisions

#: Least length of a skeleton that carries a decision, and that groups a question; consonants that group.
LEAST_CARRIED, LEAST_GROUPED, GROUPING = 6, 5, 7
#: Fixed value: what rules begin with whose answers a decision about the party replaces.
OVERRIDABLE = "trade_name:"
#: Rows without a key are spread over so many values that meet nothing.
_SPREAD = 512


def keys(c: Column) -> Column:
    """struct(kind, key, skeleton) of a narration: its party in repaired spelling ("counterparty"), else its shape ("pattern"); null where it has neither."""
    party, shape = narration.party(text.repaired(c)), F.nullif(cells.shape_key(c), F.lit(""))
    kind = F.when(party.isNotNull(), "counterparty").when(shape.isNotNull(), "pattern")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.coalesce(party, shape).alias("key"), text.skeleton(party).alias("skeleton")))


def group_key(kind: Column, key: Column, skeleton: Column) -> Column:
    """What questions are grouped by: the first consonants of a party with enough of them, else the key. Looser than what carries a decision."""
    return F.when((kind == "counterparty") & (F.length(skeleton) >= LEAST_GROUPED), F.substring(skeleton, 1, GROUPING)).otherwise(key)


def decided(events: DataFrame, owner: str, key: str, category: str, order: list[str]) -> DataFrame:
    """The memory after all decisions in order: the last category of each key, and how often it was given since it last changed. Events without owner, key or category teach nothing."""
    told = events.where(F.col(owner).isNotNull() & F.col(key).isNotNull() & F.col(category).isNotNull())
    last = decisions(told.withColumn("of_", F.struct(F.col(owner).alias("owner"), F.col(key).alias("key"))), "of_", category, order)
    return last.select("of_.owner", "of_.key", F.col(category).alias("category"), "confirmed")


def index(memory: DataFrame) -> DataFrame:
    """owner, lookup and hit(key, category, confirmed, by) of a memory, one row a lookup.

    A key is found as it is stored (exact), in repaired spelling and by its skeleton; exact comes before repaired, repaired
    before skeleton, then the more often confirmed, then the smaller key. A skeleton counts from LEAST_CARRIED consonants on,
    and only where all its decisions agree.
    """
    hit = lambda by: F.struct("key", "category", "confirmed", F.lit(by).alias("by"))
    spellings = F.array(*[F.struct(F.lit(r).alias("rank"), c.alias("lookup"), hit(by).alias("hit")) for r, c, by in ((0, F.col("key"), "exact"), (1, F.trim(text.repaired(F.col("key"))), "repaired"))])
    known = memory.where("key is not null and category is not null")
    spelt = known.select("owner", F.explode(spellings).alias("x")).select("owner", "x.*")
    bones = known.withColumn("lookup", text.skeleton(F.col("key"))).where(F.length("lookup") >= LEAST_CARRIED).groupBy("owner", "lookup").agg(
        F.min("category").alias("a"), F.max("category").alias("z"), F.min_by(hit("skeleton"), F.struct(-F.col("confirmed"), "key")).alias("hit"))
    both = spelt.unionByName(bones.where("a = z").select("owner", F.lit(2).alias("rank"), "lookup", "hit")).where("lookup != ''")
    return both.groupBy("owner", "lookup").agg(F.min_by("hit", F.struct("rank", -F.col("hit.confirmed"), "hit.key")).alias("hit"))


def lookup(rows: DataFrame, found: DataFrame, owner: str = "owner", key: str = "key", skeleton: str = "skeleton") -> DataFrame:
    """rows with hit(key, category, confirmed, by) from an index: by key, else by skeleton; null where neither is known or the row has no key or owner.

    Each different key of an owner is looked up once; equal rows, however many, are counted together before any shuffle.
    """
    asked = rows.select(F.col(owner).alias("owner"), F.col(key).alias("key"), F.col(skeleton).alias("skeleton")).where("owner is not null and key is not null").distinct()
    by = lambda c, out: asked.alias("k").join(found.alias("f"), F.expr(f"k.owner = f.owner and k.{c} = f.lookup")).select("k.owner", "k.key", "k.skeleton", F.col("f.hit").alias(out))
    hits = by("key", "hit").withColumn("rank", F.lit(0)).unionByName(by("skeleton", "hit").withColumn("rank", F.lit(1)))
    # a key has one skeleton, as it is made of it; should callers give several, each is a question of its own
    hits = hits.groupBy("owner", "key", "skeleton").agg(F.min_by("hit", "rank").alias("hit"))
    at = lambda o, k, s: F.to_json(F.struct(o.alias("o"), k.alias("k"), s.alias("s")), {"ignoreNullFields": "false"})
    nothing = F.concat(F.lit(" "), F.pmod(F.xxhash64(*[F.col(c) for c, t in rows.dtypes if not t.startswith(("map", "variant"))]), F.lit(_SPREAD)).cast("string"))
    mine = F.when(F.col(owner).isNotNull() & F.col(key).isNotNull(), at(F.col(owner), F.col(key), F.col(skeleton))).otherwise(nothing)
    hits = hits.select(at(F.col("owner"), F.col("key"), F.col("skeleton")).alias("at_"), "hit")
    return rows.withColumn("at_", mine).join(hits, "at_", "left").drop("at_")


def carried(rows: DataFrame, category: str = "category", rule: str = "rule", review: str = "requires_review", hit: str = "hit") -> DataFrame:
    """rows with the category of their hit where they wait for review or a rule answered from the party's trade name; these rows need no review, their rule is memory.

    Answers about the transaction itself stay, whoever was paid. Only category, rule and the review flag change. hit goes.
    """
    take = F.col(hit).isNotNull() & (F.coalesce(F.col(review), F.lit(False)) | F.coalesce(F.startswith(F.col(rule), F.lit(OVERRIDABLE)), F.lit(False)))
    return rows.withColumns({category: F.when(take, F.col(f"{hit}.category")).otherwise(F.col(category)), rule: F.when(take, "memory").otherwise(F.col(rule)), review: F.when(take, False).otherwise(F.col(review))}).drop(hit)
