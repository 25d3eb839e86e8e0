"""Tweets derived from the event table, as expressions both engines read.

The given tables hold no tags, so each event becomes a tweet about its type and
user.  Some texts are null and some dates unreadable, as in real input.
"""

from __future__ import annotations

TWEET_TEXT = """CASE WHEN props = '{"k": 0}' THEN NULL ELSE
 concat('Saw #', upper(event_type), ' and #u', CAST(user_id AS STRING), ' near #Señal_', event_type,
  ' on $', translate(CAST(user_id AS STRING), '0123456789', 'abcdefghij'), ' or $', event_type,
  ' at http://t.test/', event_type, '#top ', props) END"""

CREATED_AT = """CASE WHEN props = '{"k": 1}' THEN 'garbage' ELSE
 concat(CAST(CAST(ts AS DATE) AS STRING), 'T12:30:00Z') END"""

# Nested tweets: none, one retweet, a retweet that quotes, a quote, and a chain of six.
_LEVEL = '{"entities":{"hashtags":[{"text":"Deep%d"}],"urls":[{"expanded_url":"https://x.test/deep%d"}]}'
_CHAIN = "".join(
    ',"%s":' % ("retweeted_status" if n % 2 else "quoted_status") + _LEVEL % (n, n) for n in range(1, 7)
) + "}" * 6

TWEET_JSON = f"""concat('{{"entities":{{"hashtags":[{{"text":"', upper(event_type), '","indices":[0,1]}},{{"text":""}}],',
 '"urls":[{{"expanded_url":"https://x.test/u', CAST(user_id AS STRING), '"}}],"media":',
 CASE WHEN event_type = 'click' THEN 'null'
  ELSE concat('[{{"expanded_url":"https://m.test/', event_type, '"}}]') END, '}}',
 CASE event_type
  WHEN 'view' THEN ',"retweeted_status":{{"entities":{{"hashtags":[{{"text":"RtView"}}]}}}}'
  WHEN 'purchase' THEN ',"retweeted_status":{{"entities":{{"hashtags":[{{"text":"rt"}}]}},"quoted_status":{{"entities":{{"hashtags":[{{"text":"Quoted"}}]}}}}}}'
  WHEN 'signup' THEN ',"retweeted_status":null,"quoted_status":{{"entities":{{"hashtags":[{{"text":"Signed"}}]}}}}'
  WHEN 'error' THEN '{_CHAIN}'
  ELSE '' END, '}}')"""
