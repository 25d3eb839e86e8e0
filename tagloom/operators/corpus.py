"""Token corpus of hashtags and URLs from JSON tweets.

Tweets that nest few levels are parsed with a schema, in one pass and without a shuffle.
Longer chains are cut by a pattern that takes whatever a tweet holds besides nested tweets
as one piece, up to ``SIDE_LEVELS`` brackets within each other; if that leaves only the
brackets of tweets, every entity block found belongs to the chain.  This too is one pass
without a shuffle, however long the chain.
The others go into a table of their pieces (strings, brackets, the rest), where
running sums over a text give each bracket's depth, and the brackets that are open at a
place tell whether it belongs to a tweet of the chain.  This takes the time of sorting a
text's pieces, however deep it nests, and no row holds more than a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagloom.functions.text import hash_label
from tagloom.functions.tweets import (
    ANY_DEPTH,
    ENTITIES_TYPE,
    MORE_LEVELS,
    NESTED_KEYS,
    PARSED_LEVELS,
    chain_blocks,
    entity_blocks,
    entity_hashtags,
    entity_urls,
    is_plain_chain,
    is_readable,
    json_pieces,
    key_name,
    nested_tweets,
    outer_blocks,
    parse_tweet,
)


def entity_rows(tweets: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per entity block: the tweet's own at position 0, then the nested tweets'.

    Each text takes one way, by how many tweets it may nest.  Unreadable texts have no blocks.
    """
    fits = F.coalesce(nested_tweets(F.col(json)) <= PARSED_LEVELS + MORE_LEVELS, F.lit(False))
    parsed = tweets.where(fits).select(*keep, parse_tweet(F.col(json)).alias("tweet"))
    blocks = F.posexplode(entity_blocks(F.col("tweet"))).alias("position", "entities")
    shallow = parsed.select(*keep, blocks).where(F.col("entities").isNotNull())
    chain = F.coalesce(is_plain_chain(F.col(json)), F.lit(False))
    chains = chain_entity_rows(tweets.where(~fits & chain), json, keep)
    return shallow.unionByName(chains).unionByName(deep_entity_rows(tweets.where(~fits & ~chain), json, keep))


def chain_entity_rows(tweets: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for plain chains of any length; nested blocks are numbered in order of the text."""
    readable = tweets.where(is_readable(F.col(json)))
    blocks = readable.select(*keep, F.col(json).alias("_json"), F.posexplode(chain_blocks(F.col(json))).alias("_block", "_text"))
    position = F.when(F.array_contains(outer_blocks(F.col("_json")), F.col("_block")), 0).otherwise(F.col("_block") + 1)
    entities = F.from_json("_text", ENTITIES_TYPE, ANY_DEPTH)
    return blocks.select(*keep, position.alias("position"), entities.alias("entities")).where(F.col("entities").isNotNull())


def deep_entity_rows(tweets: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for tweets nested to any depth; nested blocks are numbered in order of the text."""
    named = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    rows = tweets.where(is_readable(F.col(json))).select(F.monotonically_increasing_id().alias("_id"), *named, F.col(json).alias("_json"))
    kept = [f"_keep_{i}" for i in range(len(keep))]
    pieces = rows.select("_id", *kept, F.posexplode(json_pieces(F.col("_json"))).alias("_at", "_piece"))
    text = W.partitionBy("_id").orderBy("_at")
    opens, closes = F.col("_piece").isin("{", "["), F.col("_piece").isin("}", "]")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    # blank pieces may stand between a key and its value, so the key is the last piece that is not blank
    told = F.when(F.trim("_piece") != "", F.col("_piece"))
    before = F.last(told, ignorenulls=True).over(text.rowsBetween(W.unboundedPreceding, -1))
    depth = F.sum(step).over(text.rowsBetween(W.unboundedPreceding, 0))
    placed = pieces.withColumns({"_before": before, "_depth": depth, "_step": step})
    placed = placed.withColumn("_level", F.col("_depth") + F.when(F.col("_step") == -1, 1).otherwise(0))
    key = key_name(F.col("_before"))
    is_tweet = (F.col("_piece") == "{") & (F.coalesce(key.isin(*NESTED_KEYS), F.lit(False)) | (F.col("_depth") == 1))
    kind = F.when(opens, F.when(is_tweet, "tweet").when((F.col("_piece") == "{") & (key == "entities"), "entities").otherwise("other"))
    # at one level brackets open and close in turn, so a closing one follows its opening one
    turns = W.partitionBy("_id", "_level", F.col("_step") != 0).orderBy("_at")
    kinds = placed.withColumn("_kind", kind).withColumn("_kind", F.when(closes, F.lag("_kind").over(turns)).otherwise(F.col("_kind")))
    strange = F.when(F.col("_kind") != "tweet", F.col("_step")).otherwise(0)
    kinds = kinds.withColumn("_strange", F.sum(strange).over(text.rowsBetween(W.unboundedPreceding, -1)))
    starts = opens & (F.col("_kind") == "entities") & (F.coalesce("_strange", F.lit(0)) == 0)
    block = F.sum(F.when(starts, 1).otherwise(0)).over(text.rowsBetween(W.unboundedPreceding, 0))
    level = F.last(F.when(starts, F.col("_depth")), ignorenulls=True).over(text.rowsBetween(W.unboundedPreceding, 0))
    blocks = kinds.withColumns({"_block": block, "_start": level})
    # a block's pieces are those at or below its level up to where it closes
    left = F.when(closes & (F.col("_level") == F.col("_start")), F.col("_at"))
    end = F.min(left).over(W.partitionBy("_id", "_block"))
    inside = blocks.where(F.col("_block") > 0).withColumn("_end", end).where(F.col("_at") <= F.col("_end"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_piece")))
    whole = inside.groupBy("_id", "_block", "_start", *kept).agg(F.array_join(F.transform(ordered, lambda p: p["_piece"]), "").alias("_text"))
    position = F.when(F.col("_start") == 2, 0).otherwise(F.col("_block")).cast("int")
    entities = F.from_json("_text", ENTITIES_TYPE, ANY_DEPTH)
    found = whole.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], position.alias("position"), entities.alias("entities"))
    return found.where(F.col("entities").isNotNull())


def tweet_entities(tweets: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """The hashtag and URL lists of every entity block."""
    return entity_rows(tweets, json, keep).select(
        *keep,
        "position",
        entity_hashtags(F.col("entities")).alias("hashtags"),
        entity_urls(F.col("entities")).alias("urls"),
    )


def tweet_tokens(tweets: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """``kind, token`` of every hashtag and URL, from one pass over the tweets."""
    links = F.concat(
        F.coalesce(F.col("entities.urls.expanded_url"), F.array().cast("array<string>")),
        F.coalesce(F.col("entities.media.expanded_url"), F.array().cast("array<string>")),
    )
    lists = F.inline(
        F.array(
            F.struct(F.lit("hashtag").alias("kind"), F.col("entities.hashtags.text").alias("raw")),
            F.struct(F.lit("url").alias("kind"), links.alias("raw")),
        )
    )
    rows = entity_rows(tweets, json, keep).select(*keep, lists)
    raw = rows.select(*keep, "kind", F.explode("raw").alias("raw")).where(F.col("raw") != "")
    token = F.when(F.col("kind") == "hashtag", hash_label(F.col("raw"))).otherwise(F.col("raw"))
    return raw.select(*keep, "kind", token.alias("token"))


def token_totals(tokens: DataFrame) -> DataFrame:
    """How many hashtags and how many URLs."""
    return tokens.groupBy("kind").agg(F.count(F.lit(1)).alias("tokens"))


def combined_corpus(hashtags: DataFrame, urls: DataFrame) -> DataFrame:
    """Hashtags then URLs, nothing dropped."""
    return hashtags.unionByName(urls)
