"""Artists for every user: who shared a stage, an agency or a genre with those they follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import fixed_values as V
from ..functions import text as T
from ..functions.maths import clamp01, co_performer_norm, round2, round4
from ..session import cut_lineage
from .listing import top_per_group, top_ranked

# Above this many acts an event is not spelled out act by act: being part of it becomes an
# attribute of the act, like a genre.
HOT_LINEUP = 200
# Up to this many acts, an event is spelled out as pairs of acts before the followers of one come in.
SMALL_LINEUP = 8
_W = V.ARTIST_REC_WEIGHTS


def popular_artists(artists: DataFrame, limit: int) -> DataFrame:
    return top_ranked(artists, [("popularity_score", False), ("followers_count", False)], "id", limit)


def stages_seen(followings: DataFrame, lineup: DataFrame) -> DataFrame:
    """(user_id, event_id, followed_id): events with followed acts, one row each."""
    return followings.join(lineup, "artist_id").groupBy("user_id", "event_id").agg(F.min("artist_id").alias("followed_id"))


def shared_stages(lineup: DataFrame) -> DataFrame:
    """The rows of events with two acts or more; on the others nobody is seen beside anybody."""
    shared = lineup.groupBy("event_id").agg(F.count("*").alias("n_acts")).filter("n_acts > 1")
    return lineup.join(shared.select("event_id"), "event_id", "left_semi")


def _met(followings: DataFrame, seen: DataFrame, lineup: DataFrame) -> DataFrame:
    """(user_id, artist_id, shared, event_id): acts of the events seen, but none that the user follows.

    Follows are rows of the same grouping, so that each pair is shuffled once.
    """
    no_event = F.lit(None).cast(lineup.schema["event_id"].dataType).alias("event_id")
    pair = lambda df, event, followed: df.select("user_id", "artist_id", event, F.lit(followed).alias("followed"))
    rows = pair(seen.select("user_id", "event_id").join(lineup, "event_id"), F.col("event_id"), False)
    rows = rows.unionByName(pair(followings, no_event, True))
    met = rows.groupBy("user_id", "artist_id").agg(
        F.count("event_id").alias("shared"), F.min("event_id").alias("event_id"), F.max("followed").alias("followed"))
    return met.filter(~F.col("followed")).drop("followed")


def co_performers(followings: DataFrame, event_artists: DataFrame) -> DataFrame:
    """(user_id, artist_id, shared, event_id): acts seen beside followed ones, with the first such event.

    Followed acts are first reduced to one row per user and event, so an event with several of
    them meets its lineup once; plain counts and minima keep the aggregation hash-based.
    """
    lineup = shared_stages(event_artists.select("event_id", "artist_id").distinct())
    return _met(followings, stages_seen(followings, lineup), lineup)


def _taste_base(liked: str, hot: str, genres: str, stages: str) -> Column:
    """Score from genres and very large events alone."""
    shared = F.size(F.array_intersect(F.col(hot), F.col(stages)))
    overlap = F.size(F.array_intersect(F.col(liked), F.col(genres)))
    ge = clamp01(overlap / F.greatest(F.lit(1), F.size(liked)))
    return _W["co_performer"] * co_performer_norm(shared), _W["genre"] * ge


def _score(co: Column, agency: Column, genre: Column) -> Column:
    return clamp01(_W["co_performer"] * co + _W["agency"] * agency + _W["genre"] * genre)


def _lists(matches: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """(label, liked, hot, list): artists in order of score and popularity, from groups of equal artists.

    ``matches`` scores each kind of artist (genres, stages) for each taste, ``most`` are the follows of the taste's
    users at most. A kind is needed only while fewer than limit + follows artists are in better kinds, and of a
    kind only its most popular: the others cannot pass them.
    """
    key = ["label", "liked", "hot"]
    up_to = F.sum("kind_size").over(Window.partitionBy(*key).orderBy(F.desc("base")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("kind_size").over(Window.partitionBy(*key, "base"))
    wanted = matches.withColumn("quota", F.lit(limit) + F.col("most") - (up_to - equal)).filter("quota > 0")
    rows = wanted.join(members, ["kind_label", "genres", "stages"]).filter(F.col("place") <= F.col("quota"))
    entry = F.struct((-F.col("base")).alias("less"), (-F.col("popularity_score")).alias("rarer"), "artist_id", "act_label")
    return rows.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("list"))


def _listed(users: DataFrame, lists: DataFrame, limit: int) -> DataFrame:
    """(user_id, listed, bar): the best artists not followed by what users and artists are alone, and the score of the last.

    Everybody takes the lists of their labels and the one without a label, which has all artists.
    """
    asked = users.repartition("user_id").select(
        "user_id", "liked", "hot", "labels", "follows", "n_follows", F.explode(F.concat("labels", F.array(F.lit("")))).alias("label"))
    some = F.slice("list", F.lit(1), (F.lit(limit) + F.col("n_follows")).cast("int"))
    again = lambda x: (F.col("label") == "") & F.coalesce(F.array_contains("labels", x["act_label"]), F.lit(False))
    new = F.filter(some, lambda x: ~F.array_contains("follows", x["artist_id"]) & ~again(x))
    picks = asked.join(lists, ["label", "liked", "hot"], "left").select("user_id", F.slice(new, 1, limit).alias("picks"))
    best = picks.groupBy("user_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("picks"))), 1, limit).alias("best"))
    return best.select(
        "user_id", F.transform("best", lambda x: x["artist_id"]).alias("listed"),
        F.when(F.size("best") >= limit, -F.get("best", F.lit(limit - 1))["less"]).otherwise(0.0).alias("bar"),
    )


def _beside(follows: DataFrame, cold: DataFrame, marks: DataFrame, small_lineup: int) -> DataFrame:
    """(user_id, artist_id, event_id, followed_id, mark): acts on a stage with a followed one.

    Acts of small events are pairs first, so that follows are joined once; in larger ones the followed acts are
    reduced to one row per user and event before they meet the lineup.
    """
    acts = cold.join(marks, "artist_id").select("event_id", "n_acts", "mark", F.col("artist_id").alias("other"))
    mine = cold.filter(F.col("n_acts") <= small_lineup).select("event_id", "artist_id")
    couples = mine.join(acts.filter(F.col("n_acts") <= small_lineup).drop("n_acts"), "event_id").filter(F.col("artist_id") != F.col("other"))
    columns = ["user_id", F.col("other").alias("artist_id"), "event_id", F.col("followed_id"), "mark"]
    near = follows.join(couples, "artist_id").withColumnRenamed("artist_id", "followed_id").select(*columns)
    seen = stages_seen(follows, cold.filter(F.col("n_acts") > small_lineup))
    far = seen.join(acts.filter(F.col("n_acts") > small_lineup), "event_id").filter(F.col("other") != F.col("followed_id"))
    return near.unionByName(far.select(*columns))


def artist_recommendations(
    followings: DataFrame,
    artists: DataFrame,
    event_artists: DataFrame,
    genres: DataFrame,
    limit: int,
    hot_lineup: int = HOT_LINEUP,
    small_lineup: int = SMALL_LINEUP,
) -> DataFrame:
    """(user_id, rank, artist_id, score, co_performer, agency, genre, reasons) for all users.

    Candidates come from three sides. Shared stages are listed pair by pair, except on very large
    events. Agency and genre would pair almost everybody with almost everybody, so there artists
    with the same genres and large events are one group, and only as many of the most popular of
    each group as could possibly make the list are looked at: they make lists that users of the same
    taste share, and the last score of a user's own is the bar for acts of shared stages. Every candidate
    that could pass it is scored in full, so the result is that of scoring all pairs; ``hot_lineup`` and
    ``small_lineup`` decide about the plan only.
    """
    follows = cut_lineage(followings.select("user_id", "artist_id").repartition("user_id").distinct())
    lineup = cut_lineage(event_artists.select("event_id", "artist_id").distinct())
    genres = cut_lineage(genres.select("artist_id", "genre"))
    n_acts = lineup.groupBy("event_id").agg(F.count("*").alias("n_acts")).filter("n_acts > 1 or n_acts > %d" % hot_lineup)
    staged = cut_lineage(lineup.join(n_acts, "event_id"))
    cold = staged.filter((F.col("n_acts") > 1) & (F.col("n_acts") <= hot_lineup))
    hot = staged.filter(F.col("n_acts") > hot_lineup).drop("n_acts")

    none = F.array().cast("array<string>")
    no_stage = F.array().cast(T_.ArrayType(lineup.schema["event_id"].dataType))
    acts_genres = genres.groupBy("artist_id").agg(F.array_sort(F.collect_set("genre")).alias("genres"))
    acts_stages = hot.groupBy("artist_id").agg(F.array_sort(F.collect_set("event_id")).alias("stages"))
    acts = (
        artists.select(F.col("id").alias("artist_id"), "name", T.none_if_blank(F.col("label")).alias("label"),
                       F.coalesce("popularity_score", F.lit(0.0)).alias("popularity_score"))
        .join(acts_genres, "artist_id", "left").join(acts_stages, "artist_id", "left")
        .withColumn("genres", F.coalesce("genres", none)).withColumn("stages", F.coalesce("stages", no_stage))
    )
    acts = cut_lineage(acts)

    # what users are: their follows, with the genres and labels of these
    label = T.strip("label")
    of_artist = acts.groupBy("artist_id").agg(F.count("*").alias("n_rows"), F.collect_set(F.when(label != "", label)).alias("labels"))
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    users = follows.filter(F.col("user_id").isNotNull()).join(of_artist, "artist_id", "left").join(acts_genres, "artist_id", "left")
    users = users.groupBy("user_id").agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_follows"), F.collect_set("artist_id").alias("follows"),
        all_of("labels").alias("labels"), F.array_sort(all_of("genres")).alias("liked"),
    )
    seen_hot = cut_lineage(stages_seen(follows, hot))
    on_hot = seen_hot.groupBy("user_id").agg(F.array_sort(F.collect_set("event_id")).alias("hot"))
    users = cut_lineage(users.join(on_hot, "user_id", "left").withColumn("hot", F.coalesce("hot", no_stage)))

    # groups of equal artists, of each label and of all
    most = users.agg(F.max("n_follows")).first()[0] or 0
    by_rank = [("popularity_score", False)]
    ranked = acts.select(F.col("label").alias("act_label"), "genres", "stages", "artist_id", "popularity_score")
    co_part, genre_part = _taste_base("liked", "hot", "genres", "stages")

    kinds = acts.groupBy("genres", "stages").agg(F.count("*").alias("kind_size"))
    members = top_per_group(ranked, ["genres", "stages"], by_rank, "artist_id", limit + most, "place").withColumn("kind_label", F.lit(""))
    tastes = users.groupBy("liked", "hot").agg(F.max("n_follows").alias("most"))
    traits = lambda a, b: F.concat(F.transform(a, lambda g: F.concat(F.lit("g:"), g)), F.transform(b, lambda e: F.concat(F.lit("e:"), e.cast("string"))))
    taste_traits = tastes.select("liked", "hot", "most", F.explode(traits("liked", "hot")).alias("trait"))
    kind_traits = kinds.select("genres", "stages", "kind_size", F.explode(traits("genres", "stages")).alias("trait"))
    matches = taste_traits.join(kind_traits, "trait").drop("trait").distinct().withColumn("label", F.lit(""))

    labelled = ranked.filter(F.col("act_label").isNotNull()).withColumn("kind_label", F.col("act_label"))
    label_kinds = labelled.groupBy(F.col("kind_label").alias("label"), "genres", "stages").agg(F.count("*").alias("kind_size"))
    label_members = top_per_group(labelled, ["kind_label", "genres", "stages"], by_rank, "artist_id", limit + most, "place")
    label_tastes = users.select("liked", "hot", "n_follows", F.explode("labels").alias("label"))
    label_tastes = label_tastes.groupBy("label", "liked", "hot").agg(F.max("n_follows").alias("most"))
    matches = matches.unionByName(label_tastes.join(label_kinds, "label")).withColumn("kind_label", F.col("label"))
    matches = matches.withColumn(
        "base", round4(clamp01(co_part + _W["agency"] * F.when(F.col("label") == "", 0.0).otherwise(1.0) + genre_part)))
    lists = cut_lineage(_lists(matches, members.unionByName(label_members), limit))
    own = cut_lineage(_listed(users, lists, limit))

    # acts beside followed ones that could pass the bar: a mark stands for an act's label, none for several labels
    marks = acts.groupBy("artist_id").agg(
        F.when(F.count("label") == 0, F.lit(0)).when(F.min("label") == F.max("label"), F.hash(F.min("label"))).alias("mark"))
    cell = lambda df, kind: df.select("user_id", "artist_id", "event_id", "followed_id", "mark", F.lit(kind).cast("byte").alias("kind"))
    beside = _beside(follows, cold, marks, small_lineup)
    nothing = [F.lit(None).cast(beside.schema[c].dataType).alias(c) for c in ["event_id", "followed_id", "mark"]]
    listed = own.select("user_id", F.explode("listed").alias("artist_id"), *nothing)
    # lists, follows and shared stages are rows of the same grouping, dealt by user as what comes next needs them
    rows = cell(beside, 0).unionByName(cell(listed, 1)).unionByName(cell(follows.select("*", *nothing), 2)).repartition("user_id")
    rows = rows.groupBy("user_id", "artist_id", "event_id").agg(
        F.min("followed_id").alias("followed_id"), F.max("mark").alias("mark"), F.max("kind").alias("kind"))
    pairs = rows.groupBy("user_id", "artist_id").agg(
        F.count("event_id").alias("shared"), F.min("event_id").alias("first_event"),
        F.min_by("followed_id", "event_id").alias("cold_followed"), F.max("mark").alias("mark"), F.max("kind").alias("kind"),
    ).filter("kind < 2")
    bars = own.select("user_id", "bar").join(
        users.select("user_id", (F.size("hot") > 0).alias("any_hot"), F.transform("labels", lambda x: F.hash(x)).alias("user_marks")), "user_id")
    pairs = pairs.join(bars, "user_id")
    alike = F.when(F.col("mark").isNull() | F.array_contains("user_marks", F.col("mark")), 1.0).otherwise(0.0)
    most_co = F.when(F.col("any_hot"), 1.0).otherwise(co_performer_norm(F.col("shared")))
    pairs = pairs.filter((F.col("kind") == 1) | (round4(_score(most_co, alike, F.lit(1.0))) >= F.col("bar")))
    pairs = pairs.select("user_id", "artist_id", "shared", "first_event", "cold_followed")

    # full score of every candidate, with what is known of its user in one row
    rows = pairs.join(acts.drop("name"), "artist_id").join(users.select("user_id", "liked", "hot", "labels"), "user_id")
    hot_shared = F.when(F.size("hot") > 0, F.array_intersect("hot", "stages")).otherwise(no_stage)
    ge = clamp01(F.size(F.array_intersect("liked", "genres")) / F.greatest(F.lit(1), F.size("liked")))
    rows = rows.select(
        "user_id", "artist_id", "popularity_score", "cold_followed",
        (F.col("shared") + F.size(hot_shared)).alias("shared"),
        F.coalesce(F.array_contains("labels", F.col("label")).cast("int"), F.lit(0)).alias("agency"), ge.alias("ge"),
        F.least("first_event", F.array_min(hot_shared)).alias("first_event"),
    )
    rows = rows.withColumn("co", co_performer_norm(F.col("shared")))
    rows = rows.withColumn("full", _score(F.col("co"), F.col("agency"), F.col("ge"))).withColumn("score", round4(F.col("full")))
    # those without a score come last; left out before, they would have every score worked out twice
    best = top_per_group(rows, ["user_id"], [("score", False), ("popularity_score", False)], "artist_id", limit).filter("full > 0")
    # names, genres and the act behind the first shared stage, for the listed rows only
    on_large = seen_hot.select("user_id", F.col("event_id").alias("first_event"), F.col("followed_id").alias("hot_followed"))
    best = best.join(on_large, ["user_id", "first_event"], "left").withColumn("followed_id", F.coalesce("hot_followed", "cold_followed"))
    names = artists.select(F.col("id").alias("followed_id"), F.col("name").alias("with_name"))
    best = best.join(names, "followed_id", "left")
    best = best.join(acts.select("artist_id", "name", "label", "genres"), "artist_id").join(users.select("user_id", "liked"), "user_id")
    best = best.withColumn("matched_genres", F.array_intersect("liked", "genres"))
    reasons = F.array_compact(F.array(
        F.when(F.col("shared") > 0, F.concat(F.lit("회원님이 팔로우한 "), "with_name", F.lit("와 같은 무대에 섰어요"))),
        F.when(F.col("agency") > 0, F.concat(F.lit("같은 소속사 ("), "label", F.lit(") 아티스트예요"))),
        F.when(F.size("matched_genres") > 0, F.concat(F.lit("비슷한 장르("), F.array_min("matched_genres"), F.lit(")를 해요"))),
    ))
    return best.select(
        "user_id", "rank", "artist_id", "name", "score", round2(F.col("co")).alias("co_performer"),
        round2(F.col("agency").cast("double")).alias("agency"), round2(F.col("ge")).alias("genre"), reasons.alias("reasons"),
    )


def cold_start(users: DataFrame, followings: DataFrame, popular: DataFrame) -> DataFrame:
    """Users who follow nobody get the popular list; it is a page, so it joins as a fixed few rows."""
    lonely = users.join(followings.select(F.col("user_id").alias("id")), "id", "left_anti")
    places = F.explode(F.sequence(F.lit(1), popular.agg(F.max("rank")).scalar()))
    listed = popular.select("rank", F.col("id").alias("artist_id"), "name")
    return lonely.select(F.col("id").alias("user_id"), places.alias("rank")).join(F.broadcast(listed), "rank").select(
        "user_id", "rank", "artist_id", "name", F.lit(0.0).alias("score"),
        F.array(F.lit("지금 인기 있는 아티스트")).alias("reasons"),
    )


def public_view(recommendations: DataFrame) -> DataFrame:
    """What a visitor may see: no scores."""
    return recommendations.select("user_id", "rank", "artist_id", "name", "reasons")
