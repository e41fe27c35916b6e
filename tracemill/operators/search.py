"""Ranked text search as joins over postings: BM25 by field, blended, filtered and boosted.

The index (search_index.py) is written as Parquet by ranges of tokens, read again and
refreshed by a difference. A query reads the files that hold its own tokens; what it holds
on the driver is the query and the files' first and last tokens, never documents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.model import Parsed, family
from tracemill.operators import search_index
from tracemill.operators.search_index import Index

# Words that are not indexed.
STOPWORDS = (
    "a an the and or but for nor so yet "
    "to of in on at by from up as with "
    "is are was were be been being am "
    "do does did doing done have has had having "
    "this that these those "
    "i me my myself we us our ours "
    "you your yours yourself "
    "he him his himself she her hers herself "
    "it its itself they them their theirs "
    "what which who whom whose when where why how "
    "all any both each few more most other some such "
    "no not only own same than then there through too very "
    "can will just should would could may might must shall ought "
    "if else while until because since "
    "about above across after against along among around "
    "before behind below beneath beside between beyond "
    "during except inside into like near "
    "off onto out outside over past throughout "
    "under underneath unlike upon within without "
    "again further once also "
    "s t d "
    "get got go goes going gone "
    "make made making way ways "
    "via use used using new old"
)
# Weights of the fields of sessions and of catalogue items, and of phrases found in them.
SESSION_WEIGHTS = {"session_id": 8.0, "user_prompts": 4.0, "agent_messages": 2.0, "tool_calls": 1.0}
CATALOG_WEIGHTS = {"name": 5.0, "topics": 3.0, "author": 2.0, "description": 1.0, "readme": 0.5}
PHRASE_WEIGHTS = {"user_prompts": 1.5, "agent_messages": 0.7, "tool_calls": 0.3}
# Parts of the catalogue's blended score by sort mode.
SORT_MODES = {
    "default": {"text": 0.30, "profile": 0.20, "quality": 0.30, "popularity": 0.10, "recency": 0.10},
    "personalized": {"text": 0.20, "profile": 0.50, "quality": 0.20, "popularity": 0.05, "recency": 0.05},
    "quality": {"text": 0.20, "profile": 0.00, "quality": 0.80, "popularity": 0.00, "recency": 0.00},
    "recent": {"text": 0.20, "profile": 0.00, "quality": 0.00, "popularity": 0.00, "recency": 0.80},
}
OLD_SORT_NAMES = {"popularity": "default", "relevance": "personalized"}
K1, B, EPSILON = 1.5, 0.75, 0.25
FLOOR, DECAY_DAYS, LEAST_DECAY, CATALOG_DECAY_DAYS = 0.10, 60.0, 0.3, 180.0


def words(text: Column) -> Column:
    """Lower-case letters and digits, two at least, no stop words; repeats are kept. stem() makes tokens of them."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]{2,})"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*[w for w in STOPWORDS.split() if len(w) > 1]))


def query_tokens(text: str) -> list[str]:
    """Tokens of one query, on the driver."""
    stop, out = set(STOPWORDS.split()), []
    for t in re.findall("[a-z0-9]+", text.lower()):
        if len(t) < 2 or t in stop:
            continue
        if t.endswith("ies") and len(t) >= 6:
            t = t[:-3] + "y"
        else:
            t = next((t[: -len(s)] for s in ("ing", "ed", "s") if t.endswith(s) and len(t) >= len(s) + 3), t)
        out.append(t)
    return out


def build(docs: DataFrame, doc: str, fields: list[str]) -> Index:
    """Index of the text columns `fields` of docs. For more than one query write() it, or what a query reads is worked out from the texts again."""
    return search_index.build(docs, doc, fields, words)


def stored(docs: DataFrame, doc: str, fields: list[str], path: str) -> Index:
    """build() written to a folder: the texts are cut once, and statistics are counted from the postings written."""
    return search_index.stored(docs, doc, fields, path, words)


def refresh(index: Index, docs: DataFrame, diff: DataFrame, doc: str, fields: list[str], path: str | None = None) -> Index:
    """The index without removed and changed documents and with new and changed ones: as a further segment in its own folder, or whole in another one.

    diff has the document's id and kind, as sets.change_kind() gives them. Only the texts of
    new and changed documents are cut, and what a segment adds is in proportion to them.
    """
    return search_index.refresh(index, docs, diff, doc, fields, words, path)


def session_fields(p: Parsed, argument: int = 500, result: int = 200) -> DataFrame:
    """session_id, user_prompts, agent_messages, tool_calls of each session, lower-cased: what users and agents said, and of each call its tool, its arguments' texts and its result, both cut.

    A session's steps are followed by those of the sub-agents below it, at any depth, which
    have no rows of their own: by start (those without one first), then id. Steps stand in
    their order, and a step's calls before its results. A sub-agent whose main session is
    not there is a session itself.
    """
    if "parent_id" in p.sessions.columns:
        start = F.col("created_at") if "created_at" in p.sessions.columns else F.lit(None).cast("timestamp")
        known = p.sessions.select("session_id", "parent_id", start.alias("start"))
        there = known.select(F.col("session_id").alias("parent_id"), F.lit(True).alias("there")).distinct()
        tree = family(known.join(there, "parent_id", "left").select("session_id", F.when(F.col("there"), F.col("parent_id")).alias("parent_id")))
        place = tree.join(known.select("session_id", "start"), "session_id").select("session_id", "root", F.struct((F.col("depth") > 0).alias("below"), F.col("start"), F.col("session_id").alias("s")).alias("place"))
        # Sessions that are their own ancestors are in no tree.
        alone = p.sessions.select("session_id").join(tree.select("session_id"), "session_id", "left_anti")
        place = place.unionByName(alone.select("session_id", F.col("session_id").alias("root"), F.struct(F.lit(False).alias("below"), F.lit(None).cast(dict(known.dtypes)["start"]).alias("start"), F.col("session_id").alias("s")).alias("place")))
        of = lambda rows: rows.join(place, "session_id").drop("session_id").withColumnRenamed("root", "session_id")
        sessions = place.select(F.col("root").alias("session_id")).distinct()
    else:
        of = lambda rows: rows.withColumn("place", F.lit(0))
        sessions = p.sessions.select("session_id")
    lined = lambda source: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("source") == source) & (F.coalesce("message", F.lit("")) != ""), F.struct("place", "step_idx", F.lower("message").alias("m"))))), lambda x: x.getField("m")), " ")
    said = of(p.steps.select("session_id", "step_idx", "source", "message")).groupBy("session_id").agg(lined("user").alias("user_prompts"), lined("agent").alias("agent_messages"))
    values = F.map_values(F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>"))
    texts = F.array_join(F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string")), " ")
    c = p.calls.select("session_id", "step_idx", "call_pos", "call_id", F.concat_ws(" ", "tool_name", F.nullif(F.left(F.coalesce(texts, "arguments"), F.lit(argument)), F.lit(""))).alias("t"))
    r = p.results.where("content <> ''").join(c.select("session_id", "call_id", "step_idx", "call_pos"), ["session_id", "call_id"]).select("session_id", "step_idx", "call_pos", F.left("content", F.lit(result)).alias("t"))
    both = of(c.select("session_id", "step_idx", F.lit(0).alias("k"), "call_pos", "t").unionByName(r.select("session_id", "step_idx", F.lit(1).alias("k"), "call_pos", "t")))
    used = both.groupBy("session_id").agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "step_idx", "k", "call_pos", "t"))), lambda x: x.getField("t")), " ")).alias("tool_calls"))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return sessions.join(said, "session_id", "left").join(used, "session_id", "left").select("session_id", *[empty(x) for x in ("user_prompts", "agent_messages", "tool_calls")])


#: Kinds of items that the catalogue does not show.
EXCLUDED_TYPES = ("mcp_server",)


def catalog_fields(items: DataFrame) -> DataFrame:
    """item_id and the catalogue's text fields: topics joined; author with the repository's name; description with the repository's. Excluded types are left out.

    items has item_id, type, name, topics (array), author, repo_full_name, description, repo_description, readme.
    """
    text = lambda *c: F.concat_ws(" ", *[F.nullif(F.col(x), F.lit("")) for x in c])
    rows = items.where(~F.col("type").isin(*EXCLUDED_TYPES) | F.col("type").isNull())
    return rows.select("item_id", F.coalesce("name", F.lit("")).alias("name"), F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " ").alias("topics"), text("author", "repo_full_name").alias("author"), text("description", "repo_description").alias("description"), F.coalesce("readme", F.lit("")).alias("readme"))


def listed_items(items: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """Items of which a field holds the text, in any case; all for an empty one."""
    hit = F.lit(not text.strip())
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(text.strip().lower()))
    return items.where(hit)


def plain_matches(sessions: DataFrame, query: str, doc: str = "session_id") -> DataFrame:
    """doc, score (0): sessions whose id or first message holds the query, for as long as there is no index."""
    q = F.lit(query.strip().lower())
    held = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q)
    return sessions.where(held(doc) | held("first_message")).select(F.col(doc).alias("doc"), F.lit(0.0).alias("score")) if query.strip() else sessions.limit(0).select(F.col(doc).alias("doc"), F.lit(0.0).alias("score"))


def token_scores(index: Index, wanted: list[str], fields: list[str] | None = None) -> DataFrame:
    """field, token, doc, score: BM25 of each wanted token in each document that has it. An inverse frequency below zero is replaced by a share of the mean."""
    postings, vocabulary = index.of(wanted)
    if fields:
        postings, vocabulary = (df.where(F.col("field").isin(*fields)) for df in (postings, vocabulary))
    # A query has few tokens, so its part of the vocabulary and the fields go to all tasks.
    idf = vocabulary.join(F.broadcast(index.fields), "field")
    idf = idf.select("field", "token", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    hit = postings.join(F.broadcast(idf), ["field", "token"])
    score = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.select("field", "token", "doc", score.alias("score"))


def field_scores(index: Index, query: str, fields: list[str] | None = None) -> DataFrame:
    """field, doc, score: a token that the query repeats counts as often."""
    wanted = query_tokens(query)
    times = F.lit(0)
    for t in set(wanted):
        times = F.when(F.col("token") == t, wanted.count(t)).otherwise(times)
    return token_scores(index, sorted(set(wanted)), fields).groupBy("field", "doc").agg(F.sum(F.col("score") * times).alias("score"))


def required_and_optional(index: Index, query: str, expansions: int = 10) -> tuple[list[str], list[str]]:
    """Tokens that a document must have, and beginnings-of-words alternatives of the last one.

    The last token is completed if it is unknown, has three characters at least and the query
    does not end in a space; of its completions the first ones by token count.
    """
    wanted = query_tokens(query)
    if not wanted or query[-1:].isspace():
        return wanted, []
    last = wanted[-1]
    if len(last) < 3 or len(last) > 12 or index.of([last])[1].limit(1).count():
        return wanted, []
    more = index.completions(last, expansions)
    return (wanted[:-1], more) if more else (wanted, [])


def blended(index: Index, query: str, weights: dict[str, float]) -> DataFrame:
    """doc, composite (0 to 1): weighted field scores of the documents that have all required tokens and one optional one, if any, over their maximum.

    Where nothing fits and the query has several words, the last word is dropped once.
    """
    for text in dict.fromkeys([query, query.rsplit(" ", 1)[0] if " " in query.strip() else query]):
        need, some = required_and_optional(index, text)
        every = need + some
        if not every:
            continue
        weight, times = F.lit(0.0), F.lit(0)
        for f, w in weights.items():
            weight = F.when(F.col("field") == f, w).otherwise(weight)
        for t in set(every):
            times = F.when(F.col("token") == t, every.count(t)).otherwise(times)
        has = F.collect_set("token")
        d = token_scores(index, sorted(set(every))).groupBy("doc").agg(F.sum(F.col("score") * weight * times).alias("raw"), has.alias("has"))
        d = d.where(F.size(F.array_intersect("has", F.array(*[F.lit(t) for t in sorted(set(need))]))) == len(set(need)) if need else F.lit(True))
        if some:
            d = d.where(F.arrays_overlap("has", F.array(*[F.lit(t) for t in some])))
        # One number of the hits tells both whether there are any and what to divide by.
        top, n = d.agg(F.max("raw"), F.count("*")).first()
        if n:
            return d.select("doc", (F.col("raw") / top if top > 0 else F.lit(0.0)).alias("composite"))
    return index.lengths.select("doc", F.lit(0.0).alias("composite")).limit(0)


def id_tier(doc: Column, query: str) -> Column:
    """2 if the query is the id, 1 if it is the id's part before the first dash, else 0."""
    q = query.strip().lower()
    return F.when(F.lower(doc) == q, 2).when((F.substring_index(F.lower(doc), "-", 1) == q), 1).otherwise(0)


def recency(at: Column, now: str, days: float = DECAY_DAYS, least: float = LEAST_DECAY) -> Column:
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / 86400.0
    return F.when(at.isNull(), least).otherwise(F.greatest(F.exp(-age / days), F.lit(least)))


def phrase_bonus(docs: DataFrame, doc: str, query: str, weights: dict[str, float]) -> DataFrame:
    """doc, bonus: the weights of the fields that hold the query's words as they stand.

    The whole query is tried, then without its last, then without its first word, if two
    words stay; the first of these that any document holds is used for all.
    """
    words = query.lower().split()
    tries = [" ".join(w) for w in (words, words[:-1], words[1:]) if len(w) >= 2]
    if not tries or len(query_tokens(query)) < 2:
        return docs.select(F.col(doc).alias("doc"), F.lit(0.0).alias("bonus")).limit(0)
    amount = lambda p: sum((F.when(F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(p)), w).otherwise(0.0) for f, w in weights.items()), F.lit(0.0))
    rows = docs.select(F.col(doc).alias("doc"), *[amount(p).alias(f"b{i}") for i, p in enumerate(tries)])
    hit = rows.where(" or ".join(f"b{i} > 0" for i in range(len(tries))))
    used = hit.agg(F.min(F.coalesce(*[F.when(F.col(f"b{i}") > 0, i) for i in range(len(tries))])).alias("u"))
    pick = F.get(F.array(*[F.col(f"b{i}") for i in range(len(tries))]), F.col("u"))
    return hit.join(F.broadcast(used)).select("doc", pick.alias("bonus")).where("bonus > 0")


def soft_and(index: Index, query: str) -> DataFrame:
    """doc of each document that has all of the query's tokens, or all but one of three or more; repeats count."""
    wanted = query_tokens(query)
    n = len(wanted)
    need = n - 1 if n >= 3 else n
    times = F.lit(0)
    for t in set(wanted):
        times = F.when(F.col("token") == t, wanted.count(t)).otherwise(times)
    pairs = index.of(sorted(set(wanted)))[0].select("doc", "token").distinct()
    return pairs.groupBy("doc").agg(F.sum(times).alias("m")).where(F.col("m") >= need).select("doc")


def rank_sessions(index: Index, docs: DataFrame, query: str, now: str, doc: str = "session_id", at: str = "updated_at", top: int | None = None) -> DataFrame:
    """doc, tier, score, ts of the sessions found, best first.

    score = blended score, floored, times recency, plus the phrase bonus. Order: tier, score,
    time, all falling, then id.
    """
    meta = docs.select(F.col(doc).alias("doc"), F.col(at).alias("ts"), id_tier(F.col(doc), query).alias("tier"))
    base = blended(index, query, SESSION_WEIGHTS)
    scored = meta.join(base, "doc", "left").withColumn("composite", F.coalesce("composite", F.lit(0.0)))
    best = scored.where("tier = 0").agg(F.coalesce(F.max("composite"), F.lit(0.0)).alias("best"))
    floored = scored.join(F.broadcast(best)).withColumn("composite", F.when((F.col("tier") == 0) & (F.col("composite") < FLOOR * F.col("best")), 0.0).otherwise(F.col("composite")))
    near = soft_and(index, query).withColumn("soft", F.lit(True))
    candidates = floored.join(near, "doc", "left").where("soft or tier > 0 or composite > 0").select("doc")
    bonus = phrase_bonus(docs.join(candidates.select(F.col("doc").alias(doc)), doc, "left_semi"), doc, query, {f: w for f, w in PHRASE_WEIGHTS.items() if f in docs.columns})
    final = floored.join(bonus, "doc", "left").withColumn("score", F.col("composite") * recency(F.col("ts"), now) + F.coalesce("bonus", F.lit(0.0)))
    out = final.where("tier > 0 or score > 0").select("doc", "tier", "score", "ts").orderBy(F.desc("tier"), F.desc("score"), F.desc_nulls_last("ts"), "doc")
    return out.limit(top) if top else out


def candidates(items: DataFrame, profile: str, now: str, index: Index | None = None, top: int = 100) -> DataFrame:
    """item_id, name, score of the items that suit a profile best, from which a recommendation is chosen."""
    return rank_catalog(items, "", now, sort="personalized", profile=profile, index=index, top=top).select("item_id", "name", "score")


def name_score(name: Column, query: str) -> Column:
    """10 for each word of the query in the name, 1 if the name holds it, 500 if all words are there, 1000 if the name is the query."""
    words = [w for w in re.findall("[a-z0-9]+", query.lower()) if len(w) >= 2]
    q = query.strip().lower()
    low = F.lower(F.coalesce(name, F.lit("")))
    have = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))
    flat = lambda c: F.regexp_replace(c, "[\\s_\\-]+", "")
    one = lambda cond, v: F.when(cond, v).otherwise(0)
    score = F.lit(0)
    for w in words:
        score = score + one(F.array_contains(have, w), 10)
    if len(q) >= 3:
        score = score + one(F.contains(low, F.lit(q)), 1)
    if words:
        every = F.lit(True)
        for w in words:
            every = every & F.array_contains(have, w)
        score = score + one(every, 500)
    return score + one((flat(low) == re.sub(r"[\s_\-]+", "", q)) & F.lit(bool(q)), 1000)


def effective_weights(mode: str, present: set[str]) -> dict[str, float]:
    """The weights of a sort mode, without signals that are not present, made to sum to 1; all alike if none is left."""
    w = {k: v if k in present else 0.0 for k, v in SORT_MODES[OLD_SORT_NAMES.get(mode, mode if mode in SORT_MODES else "default")].items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else {k: 1 / len(w) for k in w}


def rank_catalog(items: DataFrame, query: str, now: str, sort: str = "default", profile: str = "", kind: str | None = None, index: Index | None = None, top: int | None = None) -> DataFrame:
    """item_id, name, name_score, score, best first: by name score, score, name.

    items has item_id, type, name, topics, author, description, readme, quality_score,
    popularity, updated_at. Sort `name` orders by name within equal name scores.
    """
    rows = items if kind is None else items.where(F.col("type") == kind)
    index = index or build(items, "item_id", list(CATALOG_WEIGHTS))
    text = blended(index, query, CATALOG_WEIGHTS).select(F.col("doc").alias("item_id"), F.col("composite").alias("text")) if query.strip() else None
    liked = field_scores(index, profile) if profile.strip() else None
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    days = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("updated_at").cast("timestamp"))) / 86400.0
    rows = rows.withColumn("quality", unit(F.col("quality_score") / 100.0)).withColumn("popular", unit(F.col("popularity"))).withColumn("recent", F.coalesce(F.exp(-days / CATALOG_DECAY_DAYS), F.lit(0.0)))
    rows = rows.join(text, "item_id", "left") if text is not None else rows.withColumn("text", F.lit(0.0))
    if liked is not None:
        summed = liked.groupBy(F.col("doc").alias("item_id")).agg(F.sum("score").alias("p"))
        rows = rows.join(summed, "item_id", "left").join(F.broadcast(summed.agg(F.max("p").alias("pm")))).withColumn("profile", F.coalesce(F.col("p") / F.nullif(F.col("pm"), F.lit(0.0)), F.lit(0.0)))
    else:
        rows = rows.withColumn("profile", F.lit(0.0))
    w = effective_weights(sort, {"quality", "popularity", "recency"} | ({"text"} if text is not None else set()) | ({"profile"} if liked is not None else set()))
    score = F.lit(0.0)
    for c, k in (("text", "text"), ("profile", "profile"), ("quality", "quality"), ("popular", "popularity"), ("recent", "recency")):
        score = score + F.coalesce(F.col(c), F.lit(0.0)) * w[k]
    rows = rows.withColumn("name_score", name_score(F.col("name"), query) if query.strip() else F.lit(0)).withColumn("score", score if sort != "name" else F.lit(0.0))
    if query.strip():
        rows = rows.where("name_score > 0 or text > 0")
    out = rows.select("item_id", "name", "name_score", "score").orderBy(F.desc("name_score"), F.desc("score"), "name", "item_id")
    return out.limit(top) if top else out
