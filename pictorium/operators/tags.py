"""Tag listings, statistics, search, merging and propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def listing(tags: DataFrame, image_tags: DataFrame, min_count: int = 0, category: str | None = None, name: str | None = None) -> DataFrame:
    """``tag_id, name, category, image_count, avg_confidence``; tags without images count 0."""
    t = tags.where(F.col("category") == category) if category else tags
    t = t.where(F.col("name").ilike(f"%{name}%")) if name else t
    g = t.join(image_tags, "tag_id", "left").groupBy("tag_id", "name", "category")
    return g.agg(F.count("image_id").alias("image_count"), F.round(F.avg("confidence"), 8).alias("avg_confidence")).where(F.col("image_count") >= min_count)


def source_counts(image_tags: DataFrame) -> DataFrame:
    """``tag_id, sources``: ``source=count`` pairs, sorted."""
    g = image_tags.groupBy("tag_id", "source").agg(F.count("*").alias("n"))
    return g.groupBy("tag_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source", "n"))), ",").alias("sources"))


def of_images(image_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """``image_id, tags``: names by falling confidence, then name."""
    j = image_tags.join(tags, "tag_id").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), F.col("name").alias("name")))).alias("t"))
    return j.select("image_id", F.array_join(F.transform("t", lambda x: x["name"]), ",").alias("tags"))


def top_per_image(image_tags: DataFrame, k: int) -> DataFrame:
    return image_tags.withColumn("rank", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("confidence"), "tag_id"))).where(F.col("rank") <= k)


def statistics(image_tags: DataFrame) -> DataFrame:
    return image_tags.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))


def most_common(image_tags: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    return image_tags.groupBy("tag_id").agg(F.count("*").alias("n")).join(tags, "tag_id").select("name", "n").orderBy(F.desc("n"), "name").limit(k)


def merge_backends(a: DataFrame, b: DataFrame, wa: float = 0.4, wb: float = 0.6, threshold: float = 0.0) -> DataFrame:
    """Full merge of two backends' ``image_id, tag_id, confidence``: weighted where both have a tag."""
    j = a.withColumnRenamed("confidence", "ca").join(b.withColumnRenamed("confidence", "cb"), ["image_id", "tag_id"], "full")
    both = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    c = F.when(both, F.col("ca") * wa + F.col("cb") * wb).otherwise(F.coalesce("ca", "cb"))
    src = F.when(both, "combined").when(F.col("ca").isNotNull(), "a").otherwise("b")
    return j.select("image_id", "tag_id", F.round(c, 6).alias("confidence"), src.alias("source")).where(F.col("confidence") >= threshold)


def propagate(hits: DataFrame, parents: DataFrame, factor: float, threshold: float) -> DataFrame:
    """Direct hits and their ancestors at ``factor`` of the best leaf, the larger where both; ``parents``: ``child, ancestor`` closure."""
    up = hits.join(parents, hits["tag"] == parents["child"]).select("image_id", F.col("ancestor").alias("tag"), (F.col("confidence") * factor).alias("confidence"))
    return hits.select("image_id", "tag", "confidence").unionByName(up).groupBy("image_id", "tag").agg(F.round(F.max("confidence"), 6).alias("confidence")).where(F.col("confidence") >= threshold)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``image_id, tag_id, confidence, source``: new values win where they are there."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, (F.col("o.image_id") == F.col("n.image_id")) & (F.col("o.tag_id") == F.col("n.tag_id")), "full")
    return j.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("image_id", "tag_id", "confidence", "source")])


def sync_taxonomy(tags: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``tag_id, name, category, parent_id, inserted``: missing names get new ids, then every parent is set by its name.

    ``tags``: ``tag_id, name, category``; ``taxonomy``: ``name, category, parent`` (null for roots), a fixed
    list of some dozens. Names of ``tags`` that it lacks stay as they are, without parent.
    """
    last = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("last"))
    new = taxonomy.join(tags, "name", "left_anti").withColumn("nth", F.row_number().over(W.orderBy("name")))
    new = new.join(F.broadcast(last)).select((F.col("last") + F.col("nth")).alias("tag_id"), "name", "category", F.lit(True).alias("inserted"))  # last: one row
    every = tags.select("tag_id", "name", "category", F.lit(False).alias("inserted")).unionByName(new)
    parents = taxonomy.select("name", "parent").join(every.select(F.col("name").alias("parent"), F.col("tag_id").alias("parent_id")), "parent")
    return every.join(parents.select("name", "parent_id"), "name", "left").select("tag_id", "name", "category", "parent_id", "inserted")


def images_with(image_tags: DataFrame, tag_id, least: float = 0.0) -> DataFrame:
    """``image_id, confidence`` of a tag, surest first."""
    return image_tags.where((F.col("tag_id") == tag_id) & (F.col("confidence") >= least)).select("image_id", "confidence").orderBy(F.desc("confidence"), "image_id")


def tags_with(image_tags: DataFrame, tags: DataFrame, image_id, least: float = 0.0) -> DataFrame:
    """``tag_id, name, confidence`` of an image, surest first; confidences of three places."""
    t = image_tags.where((F.col("image_id") == image_id) & (F.col("confidence") >= least)).join(tags, "tag_id")
    return t.orderBy(F.desc("confidence"), "name").select("tag_id", "name", F.round("confidence", 3).alias("confidence"))


def images_with_any(image_tags: DataFrame, tags: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    return image_tags.join(tags.where(F.col(column).isin(names)), "tag_id").select("image_id").distinct()


def images_with_all(image_tags: DataFrame, tags: DataFrame, names: list[str], column: str = "name") -> DataFrame:
    """Images with every one of the ``names`` that ``tags`` knows; none if it knows none."""
    named = tags.where(F.col(column).isin(names))
    need = named.agg(F.count_distinct(column).alias("need"))
    have = image_tags.join(named, "tag_id").groupBy("image_id").agg(F.count_distinct(column).alias("n"))
    return have.join(F.broadcast(need)).where("n = need").select("image_id")  # need: one row


def search(tags: DataFrame, synonyms: DataFrame, text: str) -> DataFrame:
    """``tag_id, name, hit``: the tag named ``text``, in any case, then those with such a synonym (``tag_id, synonym``), each once."""
    named = tags.where(F.lower("name") == text.lower()).select("tag_id", "name", F.lit("name").alias("hit"))
    also = tags.join(synonyms.where(F.lower("synonym") == text.lower()).select("tag_id").distinct(), "tag_id").join(named.select("tag_id"), "tag_id", "left_anti")
    return named.unionByName(also.select("tag_id", "name", F.lit("synonym").alias("hit")))


def containing(tags: DataFrame, text: str) -> DataFrame:
    return tags.where(F.col("name").ilike(f"%{text}%"))


def stored(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Get or create: ``tags`` (``tag_id, name, category``) with new ids for the ``names`` (``name, category``) that it lacks.

    Ids go on from the largest, in order of name.
    """
    from .ordered import sum_before

    new = names.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("category").alias("category")).join(tags.select("name"), "name", "left_anti")
    last = tags.agg(F.coalesce(F.max("tag_id"), F.lit(0)).alias("_last"))
    new = sum_before(new, ["name"], F.lit(1), "_nth").join(F.broadcast(last))  # last: one row
    return tags.select("tag_id", "name", "category").unionByName(new.select((F.col("_last") + F.col("_nth") + 1).alias("tag_id"), "name", "category"))


def answers(replies: DataFrame, key: str, text: str, known: list[str], least: float) -> DataFrame:
    """``key, tag, confidence`` of a model's JSON replies: code fences are stripped, tags that are not ``known`` or below ``least`` go; what is no JSON gives none."""
    clean = F.regexp_replace(F.col(text), r"```(json)?", "")
    t = replies.select(key, F.explode(F.from_json(clean, "map<string,double>")).alias("tag", "confidence"))
    return t.where(F.col("tag").isin(known) & (F.col("confidence") >= least))


def remaining(images: DataFrame, image_tags: DataFrame, after=None) -> DataFrame:
    """What a tagging job that stopped has left: images without tags, past the id ``after`` of its last checkpoint."""
    i = images.where("file_type = 'image'")
    i = i if after is None else i.where(F.col("id") > after)
    return i.join(image_tags.select(F.col("image_id").alias("id")), "id", "left_anti")


def name_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The tags that either backend gave."""
    return a.select("tag_id").union(b.select("tag_id")).distinct()


def named(taxonomy: DataFrame, name: str) -> DataFrame:
    """A taxonomy's tags by name, in any case."""
    return taxonomy.where(F.lower("name") == name.lower())


def roots(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.where("parent is null")


def children(taxonomy: DataFrame) -> DataFrame:
    """``name, children``: how many tags have it as parent, 0 for leaves."""
    n = taxonomy.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("children"))
    return taxonomy.select("name").join(n, "name", "left").select("name", F.coalesce("children", F.lit(0)).alias("children"))


def paths(taxonomy: DataFrame, depth: int = 8) -> DataFrame:
    """``name, path``: names from the root down, for a taxonomy of at most ``depth`` levels; deeper tags raise."""
    t = taxonomy.select("name", F.col("name").alias("path"), F.col("parent").alias("_up"))
    up = taxonomy.select(F.col("name").alias("_name"), F.col("parent").alias("_next"))
    for _ in range(depth - 1):
        t = t.join(up, t["_up"] == up["_name"], "left").select("name", F.when(F.col("_name").isNull(), F.col("path")).otherwise(F.concat("_name", F.lit("/"), "path")).alias("path"), F.col("_next").alias("_up"))
    whole = F.when(F.col("_up").isNull(), F.col("path")).otherwise(F.raise_error(F.lit("a tag below the deepest level")))
    return t.select("name", whole.alias("path"))
