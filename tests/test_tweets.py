from __future__ import annotations

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from tagloom.functions.tweets import SIDE_LEVELS, is_plain_chain
from tagloom.operators.corpus import chain_entity_rows, deep_entity_rows, entity_rows, token_totals, tweet_entities, tweet_tokens
from tagloom.plans import corpus
from tagloom.sources.tweets import read_tweets_json, unreadable_tweets
from tests.conftest import rows

NESTED = {
    "entities": {"hashtags": [{"text": "A", "indices": [0, 1]}, {"text": ""}], "urls": [{"expanded_url": "u1"}], "media": None},
    "retweeted_status": {"entities": {"hashtags": [{"text": "B"}]}, "quoted_status": {"entities": {"hashtags": [{"text": "C"}]}}},
}


def expected_tokens(tweet: dict) -> list[tuple[str, str]]:
    """Plain walk over one tweet, the rule the Spark code must follow."""
    entities = tweet.get("entities") or {}
    found = [("hashtag", "#" + h["text"].lower()) for h in entities.get("hashtags") or [] if h.get("text")]
    for key in ("urls", "media"):
        found += [("url", u["expanded_url"]) for u in entities.get(key) or [] if u.get("expanded_url")]
    for key in ("retweeted_status", "quoted_status"):
        if tweet.get(key):
            found += expected_tokens(tweet[key])
    return found


def random_tweet(rng: random.Random, depth: int) -> dict:
    tweet: dict = {}
    if rng.random() < 0.9:
        tweet["entities"] = None if rng.random() < 0.1 else {
            "hashtags": [{"text": rng.choice(["Ab", "ñ", "", None, "x_status\""])} for _ in range(rng.randint(0, 3))],
            "urls": rng.choice([None, [], [{"expanded_url": "http://u/1"}], [{"expanded_url": ""}, {}]]),
            "media": rng.choice([None, [{"expanded_url": "http://m/{}"}]]),
        }
    for key in ("retweeted_status", "quoted_status"):
        if depth and rng.random() < 0.6:
            tweet[key] = random_tweet(rng, depth - 1)
        elif rng.random() < 0.2:
            tweet[key] = None
    return tweet


def test_fixture_order(spark):
    df = spark.createDataFrame([(json.dumps(NESTED),)], "json string")
    lists = tweet_entities(df).orderBy("position").collect()
    assert [t for r in lists for t in r["hashtags"]] == ["#a", "#b", "#c"]
    assert [t for r in lists for t in r["urls"]] == ["u1"]


def test_any_depth(spark):
    rng = random.Random(7)
    tweets = [random_tweet(rng, 9) for _ in range(60)]
    for ascii_only in (True, False):
        df = spark.createDataFrame([(json.dumps(t, ensure_ascii=ascii_only),) for t in tweets], "json string")
        got = Counter((r["kind"], r["token"]) for r in tweet_tokens(df).collect())
        assert got == Counter(x for t in tweets for x in expected_tokens(t))


def test_a_chain_of_two_hundred(spark):
    chain: dict = {"entities": {"hashtags": [{"text": "end"}]}}
    for level in range(200):
        chain = {"entities": {"hashtags": [{"text": "x"}]}, ("quoted_status" if level % 2 else "retweeted_status"): chain}
    df = spark.createDataFrame([(json.dumps(chain),)], "json string")
    assert Counter(r["token"] for r in tweet_tokens(df).collect()) == {"#x": 200, "#end": 1}


def chain(levels: int) -> str:
    text = '{"entities":{"hashtags":[{"text":"end"}]}}'
    for _ in range(levels):
        text = '{"entities":{"hashtags":[{"text":"x"}]},"retweeted_status":' + text + "}"
    return text


def test_a_chain_beyond_the_parsers_bound(spark):
    df = spark.createDataFrame([(chain(1200),), (chain(2500),), (chain(1200)[:-1],)], "json string")
    assert Counter(r["token"] for r in tweet_tokens(df).collect()) == {"#x": 3700, "#end": 2}


def test_only_tweets_of_the_chain_count(spark):
    lookalikes = [
        '{"a":{"retweeted_status":{"entities":{"hashtags":[{"text":"no"}]}}},"quoted_status":{"quoted_status":{"entities":{"hashtags":[{"text":"yes"}]}}}}',
        '{"entities":{"retweeted_status":{"entities":{"hashtags":[{"text":"no"}]}}, "hashtags" : [ {"text" : "a\\"b{" , "x":[[]]} ] },"quoted_status":null,"retweeted_status":{ }}',
        '{"retweeted_status":{"retweeted_status":{"x":"\\\\","retweeted_status":{"y":"}\\\\\\"{","entities":{"urls":[{"expanded_url":"\\u0068\\/\\\\"}]}}},"entities":{"hashtags":[{"text":"late"}]}},"entities" : {"hashtags":[{"text":"own"}],"user_mentions":[{"entities":{"hashtags":[{"text":"no"}]}}]}}',
        '{"retweeted\\u005fstatus":{"quoted_status":{"quoted_status":{"entities":{"hashtags":[{"text":"spelled"}]}}}}}',
        '[{"quoted_status":{"quoted_status":{"quoted_status":{"entities":{"hashtags":[{"text":"no"}]}}}}}]',
    ]
    df = spark.createDataFrame([(i, text) for i, text in enumerate(lookalikes)], "id int, json string")
    got = rows(tweet_tokens(df, keep=("id",)))
    want = [(i, *x) for i, text in enumerate(lookalikes[:4]) for x in expected_tokens(json.loads(text))]
    assert got == sorted(want, key=repr)
    assert {t for _, _, t in got} == {"#yes", '#a"b{', "h/\\", "#late", "#own", "#spelled"}
    own = tweet_entities(df, keep=("id",)).where("position = 0").collect()
    assert {r["id"]: r["hashtags"] for r in own} == {1: ['#a"b{'], 2: ["#own"]}


def test_both_ways_give_the_same_blocks(spark):
    rng = random.Random(3)
    tweets = [json.dumps(random_tweet(rng, 2)) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(tweets)), "id int, json string")
    deep = deep_entity_rows(df, keep=("id",))
    assert rows(deep.select("id", "entities")) == rows(entity_rows(df, keep=("id",)).select("id", "entities"))


def test_long_chains_need_no_shuffle(spark):
    rng = random.Random(5)
    deep_side = "[" * (SIDE_LEVELS + 4) + "]" * (SIDE_LEVELS + 4)
    tweets = [json.dumps(random_tweet(rng, 9)) for _ in range(60)] + [chain(40), chain(1200)]
    late = '{"quoted_status" : ' + chain(9) + ', "user":{"entities":{"retweeted_status":{"entities":{}}}}, "entities":{"hashtags":[{"text":"late}"}]}}'
    tweets += [late, late.replace('"entities":{}', f'"entities":{{"x":{deep_side}}}'), late[:-1]]
    df = spark.createDataFrame(list(enumerate(tweets)), "id int, json string")
    plain = df.where(is_plain_chain(F.col("json")))
    assert [r["id"] for r in df.exceptAll(plain).select("id").collect()] == [len(tweets) - 2]
    read = chain_entity_rows(plain, keep=("id",))
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()
    assert rows(read, "id", "position", "entities") == rows(deep_entity_rows(plain, keep=("id",)), "id", "position", "entities")
    assert entity_rows(df.where(df["id"] >= len(tweets) - 3), keep=("id",)).groupBy("id").count().where("count = 11").count() == 2


def test_unreadable_lines_give_no_tokens_and_are_reported(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"entities":{"hashtags":[{"text":"Z"}]}}\n\n   \n{broken\n')
    df = read_tweets_json(spark, str(tmp_path / "t.json"))
    assert df.count() == 2
    assert rows(tweet_tokens(df)) == [("hashtag", "#z")]
    assert unreadable_tweets(df).count() == 1


def test_corpus_plan(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join([json.dumps(NESTED)] * 3))
    (tmp_path / "in.json").write_text("\n".join([json.dumps(NESTED)] * 3 + ["", "{broken", "[1]"]))
    result = corpus.run(spark, str(tmp_path / "in.json"), str(tmp_path / "out"))
    assert (result.lines, result.unreadable) == (5, 2)
    assert rows(result.totals) == [("hashtag", 9), ("url", 3)]
    assert [tuple(r) for r in result.counts.collect()] == [("#a", 3), ("#b", 3), ("#c", 3), ("u1", 3)]
    written = spark.read.text(str(tmp_path / "out" / "word_counts"))
    assert rows(written) == [("(#a,3)",), ("(#b,3)",), ("(#c,3)",), ("(u1,3)",)]
    assert rows(token_totals(tweet_tokens(read_tweets_json(spark, str(tmp_path / "in.json"))))) == [("hashtag", 9), ("url", 3)]
