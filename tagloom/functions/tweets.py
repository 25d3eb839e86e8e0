"""Expressions for the entities of JSON tweets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import hash_label

ENTITIES_TYPE = (
    "struct<hashtags: array<struct<text: string>>, "
    "urls: array<struct<expanded_url: string>>, "
    "media: array<struct<expanded_url: string>>>"
)


# Tweets nest as retweet and quote.
NESTED_KEYS = ("retweeted_status", "quoted_status")
# Levels below the tweet that a schema covers, as much as real input has; it doubles with each level.
PARSED_LEVELS = 2
# Levels below those that are parsed in a second step, from the text left over.
MORE_LEVELS = 4
# The parser's own bound on nesting, lifted.
ANY_DEPTH = {"maxNestingDepth": str(2**31 - 1)}


def tweet_type(levels: int, rest: bool = False) -> str:
    """Tweet schema down to ``levels`` nested tweets; ``rest`` keeps what lies deeper as raw JSON."""
    below = tweet_type(levels - 1, rest) if levels else "string"
    nested = "".join(f", {k}: {below}" for k in NESTED_KEYS) if levels or rest else ""
    return f"struct<entities: {ENTITIES_TYPE}{nested}>"


def parse_tweet(json: Column) -> Column:
    """One pass over the text; anything missing, null or unreadable is null."""
    return F.from_json(json, tweet_type(PARSED_LEVELS, rest=True), ANY_DEPTH)


def is_readable(json: Column) -> Column:
    """Whether the text is one JSON object, nested to any depth."""
    options = {**ANY_DEPTH, "columnNameOfCorruptRecord": "_corrupt"}
    read = F.from_json(json, "_corrupt string", options)
    return read.isNotNull() & read["_corrupt"].isNull() & F.ltrim(json).startswith("{")


def nested_tweets(json: Column) -> Column:
    """A bound on the tweets nested in a text: how often it names one.  No bound, null, where names are spelled with escapes."""
    mark = '_status"'
    named = (F.length(json) - F.length(F.replace(json, F.lit(mark), F.lit("")))) / len(mark)
    return F.when(~json.rlike(r"\\u00[4-7]"), named)


def _parsed_nodes(node: Column, levels: int) -> list[Column]:
    """The tweet and its parsed nested tweets, depth first."""
    if levels == 0:
        return [node]
    return [node] + [n for key in NESTED_KEYS for n in _parsed_nodes(node[key], levels - 1)]


def _raw_nodes(node: Column, levels: int) -> list[Column]:
    """The raw JSON below the last parsed level."""
    if levels == 0:
        return [node[key] for key in NESTED_KEYS]
    return [n for key in NESTED_KEYS for n in _raw_nodes(node[key], levels - 1)]


def entity_blocks(tweet: Column) -> Column:
    """Entity blocks of a parsed tweet and of the tweets nested in it, up to both steps' levels; absent tweets leave nulls behind."""
    parsed = F.array(*[n["entities"] for n in _parsed_nodes(tweet, PARSED_LEVELS)])
    raw, below = _raw_nodes(tweet, PARSED_LEVELS), MORE_LEVELS - 1
    again = F.transform(F.array_compact(F.array(*raw)), lambda text: F.from_json(text, tweet_type(below)))
    more = F.flatten(F.transform(again, lambda t: F.array(*[n["entities"] for n in _parsed_nodes(t, below)])))
    return F.when(F.coalesce(*raw).isNull(), parsed).otherwise(F.concat(parsed, more))


def json_pieces(json: Column) -> Column:
    """A JSON text cut into strings (a key with its colon), brackets, and what stands between them.

    Escaped quotes and backslashes are spelled as code points first, so that a quote ends
    a string wherever it stands.
    """
    plain = F.replace(json, F.lit("\\\\"), F.lit("\\u005c"))
    plain = F.replace(plain, F.lit('\\"'), F.lit("\\u0022"))
    return F.regexp_extract_all(plain, F.lit(r'"[^"]*"(?:\s*:)?|[{}\[\]]|[^"{}\[\]]+'), F.lit(0))


# Brackets within each other, below a tweet's key, that one piece of a chain covers.
SIDE_LEVELS = 16


# Possessive throughout, so that text is matched without a stack or a second try.
STRING = r'"(?:[^"\\]++|\\.)*+"'


def _side_value(levels: int) -> str:
    """Pattern of a bracket with all it holds."""
    below = "|" + _side_value(levels - 1) if levels > 1 else ""
    return rf'[{{\[](?:[^"{{}}\[\]]++|{STRING}{below})*+[}}\]]'


def chain_pieces(json: Column) -> Column:
    """A JSON tweet cut more coarsely: what opens a nested tweet, keys with the whole bracket they name, other brackets, and the rest."""
    tweet = rf'"(?:{"|".join(NESTED_KEYS)})"\s*+:\s*+\{{'
    side = rf"{STRING}\s*+:\s*+{_side_value(SIDE_LEVELS)}"
    rest = rf'(?:[^"{{}}\[\]]++|{STRING}(?!\s*+:\s*+[{{\[]))++'
    return F.regexp_extract_all(json, F.lit(rf"{tweet}|{side}|[{{}}\[\]]|{rest}|{STRING}\s*+:"), F.lit(0))


def is_plain_chain(json: Column) -> Column:
    """Whether ``chain_pieces`` leaves no bracket open but those of tweets: nothing else nests deeper than a piece covers."""
    loose = F.filter(chain_pieces(json), lambda p: p.isin("{", "["))
    return ~json.rlike(r'\\u00[4-7][^"]*"\s*:') & (F.size(loose) == 1)


def chain_blocks(json: Column) -> Column:
    """The texts of the entity blocks of a plain chain, in order."""
    blocks = F.filter(chain_pieces(json), lambda p: p.rlike(ENTITIES_PIECE))
    return F.transform(blocks, lambda p: F.substr(p, F.instr(p, "{")))


ENTITIES_PIECE = r'^"entities"\s*:\s*\{'


def outer_blocks(json: Column) -> Column:
    """The numbers, from 0, of the blocks that belong to the outermost tweet."""
    none = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("outer"))

    def step(state: Column, piece: Column) -> Column:
        block = piece.rlike(ENTITIES_PIECE)
        move = F.when(block, 0).when(piece.endswith("{"), 1).when(piece == "}", -1).otherwise(0)
        outer = F.when(block & (state["depth"] == 1), F.concat(state["outer"], F.array(state["n"]))).otherwise(state["outer"])
        return F.struct((state["depth"] + move).alias("depth"), (state["n"] + block.cast("int")).alias("n"), outer.alias("outer"))

    return F.aggregate(chain_pieces(json), none, step)["outer"]


def key_name(piece: Column) -> Column:
    """The name in a key's piece; null for other pieces."""
    name = F.regexp_extract(piece, r'^"([^"]*)"\s*:$', 1)
    spelled = F.from_json(F.concat(F.lit('["'), name, F.lit('"]')), "array<string>")
    return F.when(piece.endswith(":") & piece.startswith('"'), F.when(name.contains("\\"), F.get(spelled, F.lit(0))).otherwise(name))


def _non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")


def entity_hashtags(entities: Column) -> Column:
    """``#text`` of every hashtag, lower-cased, empty ones dropped."""
    listed = F.coalesce(entities["hashtags"], F.array().cast("array<struct<text: string>>"))
    return _non_empty(F.transform(listed, lambda h: hash_label(h["text"])))


def entity_urls(entities: Column) -> Column:
    """Expanded URLs of links, then of media, empty ones dropped."""
    none = F.array().cast("array<struct<expanded_url: string>>")
    both = F.concat(
        F.coalesce(entities["urls"], none),
        F.coalesce(entities["media"], none),
    )
    return _non_empty(F.transform(both, lambda u: u["expanded_url"]))
