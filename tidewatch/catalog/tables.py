"""Tag and profile tables."""

from pyspark.sql import functions as F

from tidewatch.catalog.base import (
    MID, PROFILES, TAGS, ev, present_tags, profile_updates, profile_versions, query, tag_changes,
)
from tidewatch.operators import profiles, tags

TAG_SQL = "user_id, tag_name, value, source, round(confidence, 2) AS confidence, expire_at, ts"


def _shown(df):
    return df.withColumn("confidence", F.round("confidence", 2))


@query("current_tags", f"WITH {TAGS} SELECT {TAG_SQL} FROM tags")
def current_tags(spark, d):
    return _shown(present_tags(spark, d))


@query("tags_as_of", f"""WITH {TAGS}, past AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, tag_name ORDER BY ts DESC) AS rn FROM changes
  WHERE ts <= TIMESTAMP '2024-01-15')
  SELECT {TAG_SQL} FROM past WHERE rn = 1 AND NOT deleted AND (expire_at IS NULL OR expire_at > TIMESTAMP '2024-01-15')""")
def tags_as_of(spark, d):
    return _shown(tags.current_tags(tag_changes(ev(spark, d)), MID))


@query("tag_change_feed", f"""WITH {TAGS} SELECT CASE WHEN deleted THEN 'delete' ELSE 'update' END AS operation, source,
  count(*) AS changes FROM changes GROUP BY ALL""")
def tag_change_feed(spark, d):
    op = F.when(F.col("deleted"), F.lit("delete")).otherwise(F.lit("update"))
    return tag_changes(ev(spark, d)).groupBy(op.alias("operation"), "source").agg(F.count(F.lit(1)).alias("changes"))


@query("user_tags", f"WITH {TAGS} SELECT {TAG_SQL} FROM tags WHERE user_id = '7'")
def user_tags(spark, d):
    return _shown(tags.user_tags(present_tags(spark, d), "7"))


@query("batch_tags", f"""WITH {TAGS} SELECT {TAG_SQL} FROM tags WHERE tag_name IN ('pref_1', 'pref_2')
  AND user_id IN (SELECT user_id FROM ev WHERE event_type = 'purchase' AND value > 100)""")
def batch_tags(spark, d):
    buyers = ev(spark, d).filter((F.col("event_type") == "purchase") & (F.col("value") > 100))
    return _shown(tags.batch_tags(present_tags(spark, d), buyers, ["pref_1", "pref_2"]))


@query("batch_tags_listed", f"WITH {TAGS} SELECT {TAG_SQL} FROM tags WHERE user_id IN ('1', '2', '3')")
def batch_tags_listed(spark, d):
    return _shown(tags.batch_tags(present_tags(spark, d), ["1", "2", "3"]))


@query("tag_maps", f"""WITH {TAGS} SELECT user_id, count(*) AS tag_count,
  max(value) FILTER (tag_name = 'pref_1') AS pref_1,
  count(*) FILTER (tag_name <> 'pref_1') AS without_pref_1,
  count(*) FILTER (tag_name <> 'new') + 1 AS with_new FROM tags GROUP BY user_id""")
def tag_maps(spark, d):
    rows = tags.tag_maps(present_tags(spark, d))
    held = F.col("tags")
    record = F.struct(
        F.lit("x").alias("value"), F.lit("AUTO").alias("source"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("timestamp").alias("expire_at"), F.lit(MID).cast("timestamp").alias("ts"),
    )
    size = lambda m: F.size(m).cast("bigint")
    return rows.select(
        "user_id", size(held).alias("tag_count"), tags.map_tag(held, "pref_1")["value"].alias("pref_1"),
        size(tags.map_remove_tag(held, "pref_1")).alias("without_pref_1"),
        size(tags.map_set_tag(held, "new", record)).alias("with_new"),
    )


@query("users_by_tag", f"WITH {TAGS} SELECT user_id FROM tags WHERE tag_name = 'pref_3' AND value = 'click'")
def users_by_tag(spark, d):
    return tags.users_with_tag(present_tags(spark, d), "pref_3", "click")


@query("users_by_tag_name", f"WITH {TAGS} SELECT user_id FROM tags WHERE tag_name = 'pref_3'")
def users_by_tag_name(spark, d):
    return tags.users_with_tag(present_tags(spark, d), "pref_3")


@query("tag_statistics", f"WITH {TAGS} SELECT tag_name, count(DISTINCT user_id) AS user_count FROM tags GROUP BY tag_name")
def tag_statistics(spark, d):
    return tags.tag_statistics(present_tags(spark, d))


@query("tag_distribution", f"""WITH {TAGS} SELECT tag_name, value, count(*) AS user_count FROM tags
  WHERE tag_name = 'pref_2' GROUP BY ALL""")
def tag_distribution(spark, d):
    return tags.tag_distribution(present_tags(spark, d), "pref_2")


@query("tags_removed", f"""WITH {TAGS}, gone AS (SELECT user_id, max("timestamp") AS gone_at FROM ev WHERE event_type = 'purchase' AND value > 100 GROUP BY 1)
  SELECT {TAG_SQL} FROM tags LEFT JOIN gone USING (user_id) WHERE NOT (tag_name = 'pref_1' AND coalesce(gone_at >= ts, false))""")
def tags_removed(spark, d):
    events = ev(spark, d)
    buyers = events.filter((F.col("event_type") == "purchase") & (F.col("value") > 100))
    removed = tags.removals(buyers, F.col("user_id"), F.lit("pref_1"), F.col("timestamp"))
    return _shown(tags.current_tags(tag_changes(events).unionByName(removed)))


@query("tags_replaced", f"""WITH {TAGS}, wanted AS (
  SELECT user_id, max("timestamp") + INTERVAL 1 DAY AS at FROM ev WHERE event_type = 'purchase' AND value > 100 GROUP BY 1), after AS (
  SELECT user_id, tag_name, value FROM tags WHERE user_id NOT IN (SELECT user_id FROM wanted)
  UNION ALL SELECT user_id, 'pref_0', 'fixed' FROM wanted UNION ALL SELECT user_id, 'fresh', 'fixed' FROM wanted)
  SELECT * FROM after""")
def tags_replaced(spark, d):
    events = ev(spark, d)
    buyers = events.filter((F.col("event_type") == "purchase") & (F.col("value") > 100))
    end = F.lit(MID.replace(month=3)).cast("timestamp")
    users = buyers.groupBy("user_id").agg(F.max("timestamp").alias("at"))
    named = users.withColumn("tag", F.explode(F.array(F.lit("pref_0"), F.lit("fresh"))))
    wanted = tags.change_rows(named, F.col("user_id"), F.col("tag"), F.lit("fixed"), end)
    log = tag_changes(events)
    done = tags.replace_tags(tags.current_tags(log), wanted)
    return tags.current_tags(log.unionByName(done)).select("user_id", "tag_name", "value")


@query("tag_log_compacted", f"WITH {TAGS} SELECT {TAG_SQL} FROM tags")
def tag_log_compacted(spark, d):
    return _shown(tags.compact(tag_changes(ev(spark, d))).drop("deleted", "seq"))


# --- profiles ---------------------------------------------------------------

def _stored(spark, d):
    return profiles.latest_profiles(profile_versions(ev(spark, d)))


def _flat(df):
    return df.withColumn("behavior_tags", F.array_join("behavior_tags", ","))


@query("profile_upsert", f"WITH {PROFILES} SELECT * FROM profiles")
def profile_upsert(spark, d):
    return _flat(_stored(spark, d))


UPDATED = PROFILES + """, updates AS (
  SELECT user_id, arg_max(props, "timestamp") FILTER (k % 3 = 0) AS stat_tags,
         CASE WHEN count(*) FILTER (k % 2 = 0) > 0 THEN 'high' END AS risk_level,
         min("timestamp") AS first, max("timestamp") AS at
  FROM ev WHERE event_type = 'error' GROUP BY user_id), merged AS (
  SELECT user_id, CASE WHEN p.user_id IS NULL THEN '{}' ELSE p.basic_info END AS basic_info,
         CASE WHEN p.user_id IS NULL THEN '' ELSE p.behavior_tags END AS behavior_tags,
         coalesce(u.stat_tags, p.stat_tags, '{}') AS stat_tags, '{}' AS predict_tags,
         coalesce(u.risk_level, p.risk_level, 'low') AS risk_level,
         coalesce(p.create_time, u.first) AS create_time, coalesce(u.at, p.update_time) AS update_time
  FROM profiles p FULL JOIN updates u USING (user_id))"""


def _merged(spark, d):
    return profiles.partial_update(_stored(spark, d), profiles.merge_updates(profile_updates(ev(spark, d))))


@query("profile_partial_update", f"WITH {UPDATED} SELECT * FROM merged")
def profile_partial_update(spark, d):
    return _flat(_merged(spark, d))


@query("users_by_risk", f"WITH {UPDATED} SELECT user_id FROM merged WHERE risk_level = 'high'")
def users_by_risk(spark, d):
    return profiles.users_by_risk(_merged(spark, d), "high")


@query("profile_by_user", f"WITH {PROFILES} SELECT user_id, risk_level, update_time FROM profiles WHERE user_id = '7'")
def profile_by_user(spark, d):
    return profiles.profile_of(_stored(spark, d), "7").select("user_id", "risk_level", "update_time")


@query("user_count", f"WITH {PROFILES} SELECT count(*) AS user_count FROM profiles")
def user_count(spark, d):
    return profiles.count_users(_stored(spark, d))


@query("delete_users", f"""WITH {PROFILES}, {TAGS[TAGS.index("changes AS"):]}, gone AS (
  SELECT user_id FROM ev WHERE event_type = 'purchase' AND value > 100)
  SELECT 'profiles' AS name, count(*) AS kept FROM profiles WHERE user_id NOT IN (SELECT user_id FROM gone)
  UNION ALL SELECT 'tags', count(*) FROM tags WHERE user_id NOT IN (SELECT user_id FROM gone)
  UNION ALL SELECT 'events', count(*) FROM ev WHERE user_id NOT IN (SELECT user_id FROM gone)""")
def delete_users(spark, d):
    events = ev(spark, d)
    gone = events.filter((F.col("event_type") == "purchase") & (F.col("value") > 100))
    kept = profiles.delete_users([_stored(spark, d), present_tags(spark, d), events], gone)
    counts = [
        t.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(n).alias("name"), "kept")
        for n, t in zip(("profiles", "tags", "events"), kept)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
