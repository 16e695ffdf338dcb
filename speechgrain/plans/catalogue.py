"""Named queries over the driver's tables. ``oracle`` has the SQL of the same names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechgrain.functions import text as T
from speechgrain.operators import catalog, chunks, clips, cluster, flows, fuzzy, intervals, matching, pcm, render, segments, speakers
from speechgrain.plans import datasets as D
from speechgrain.plans import jobs, oracle
from speechgrain.sources import transcripts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
THRESHOLD, MARGIN = 0.2, 0.05


def lines(spark, sf) -> DataFrame:
    """Lines of orders with a number of their own, ``n``, within the order."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return D.table(spark, sf, "lineitem").withColumn("n", F.row_number().over(order).cast("long"))


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return _QUERIES | jobs.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracle.sql() | jobs.SQL


def joined(c: str) -> Column:
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), "|").alias(c)


def ranges(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    """A literal table of a few rows, which may be broadcast whatever the input's size."""
    return F.broadcast(spark.createDataFrame(rows, "source string, range_start_ms long, range_end_ms long"))


RANGES = [("mic", 0, 400_000), ("mic", 300_000, 900_000), ("system", 1_000_000, 1_500_000), ("system", 2_400_000, 2_500_000)]

# --- segments ----------------------------------------------------------------------------------------------------------


@query
def speaker_summary(spark, sf):
    return speakers.summary(D.seg(spark, sf)).select("session_id", "speaker_id", "segments", "useful_segments", "speech_ms", "useful_speech_ms", "source", "speaker_name", joined("examples"))


@query
def speaker_stats(spark, sf):
    return speakers.stats(D.seg(spark, sf))


@query
def source_extent(spark, sf):
    return speakers.source_extent(D.seg(spark, sf))


@query
def session_sources(spark, sf):
    s = D.seg(spark, sf)
    return s.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"), F.max("end_ms").alias("duration_ms"))


@query
def normalize_segments(spark, sf):
    e = D.table(spark, sf, "events")
    raw = e.select(F.col("event_id").alias("seg_idx"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("start_time"), F.col("value").cast("string").alias("start"), F.when(F.col("event_id") % 7 == 0, F.lit("none")).otherwise((F.floor(F.col("value")) + 5).cast("string")).alias("end_time"), F.col("user_id").alias("speaker"), F.when(F.col("event_id") % 11 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))).alias("text"))
    return segments.shift(segments.normalize(raw), 5000).select("seg_idx", "speaker_id", "start_ms", "end_ms", "duration_ms", "text")


@query
def speech_predicates(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("["), F.col("p_name"), F.lit("]"))).when(F.col("p_partkey") % 6 == 1, F.lit("[]")).when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("[a] "), F.col("p_name"), F.lit(" [b]"))).when(F.col("p_partkey") % 6 == 3, F.lit("  ")).otherwise(F.col("p_name")).alias("text"))
    return p.select("p_partkey", T.is_bracketed(F.col("text")).alias("bracketed"), T.is_tag(F.col("text")).alias("tag"), T.is_useful(F.col("text")).alias("useful"))


@query
def track_merge_order(spark, sf):
    s = D.seg(spark, sf)
    tracks = {name: s.where(F.col("source") == name).drop("source") for name in ("mic", "system")}
    return segments.merge_tracks(tracks).select("session_id", "seg_idx", "source", "start_ms", "position")


@query
def render_lines(spark, sf):
    return render.transcript(D.turns(spark, sf))


@query
def flatten_text(spark, sf):
    t = D.turns(spark, sf).withColumn("start_ms", F.col("seg_idx") * 2000).withColumn("end_ms", F.col("seg_idx") * 2000 + 1500)
    return segments.flattened(t.withColumn("speaker_id", F.when(F.col("seg_idx") % 2 == 0, F.col("speaker_id"))))


@query
def first_examples(spark, sf):
    return speakers.first_texts(D.turns(spark, sf), ["session_id", "speaker_id"]).select("session_id", "speaker_id", "seg_idx", F.col("rank").cast("long").alias("rank"), "text")


@query
def positional_labels(spark, sf):
    s = D.seg(spark, sf).select("session_id", F.col("source").alias("track"), "seg_idx", "start_ms")
    labels = s.select("session_id", "track", "seg_idx", (F.col("seg_idx") % 4).cast("string").alias("speaker_id"))
    return segments.write_labels(s, labels).select("session_id", "track", "seg_idx", "speaker_id")


@query
def named_speakers(spark, sf):
    names = spark.createDataFrame([("click", "Ana"), ("view", "Ben")], "speaker_id string, speaker_name string")
    return segments.stamp_names(D.seg(spark, sf), F.broadcast(names), ("speaker_id",)).select("session_id", "seg_idx", "speaker_id", "speaker_name")


@query
def single_speaker(spark, sf):
    """What one speaker of each conversation says, tags left out."""
    t = D.turns(spark, sf).withColumn("text", F.when(F.col("seg_idx") % 3 == 0, F.lit("[laughs]")).otherwise(F.trim("text")))
    return segments.single_speaker_text(t, "user")


@query
def fallback_texts(spark, sf):
    """Conversations as tracks that have texts only: one row a track."""
    t = D.turns(spark, sf).groupBy("session_id", F.col("speaker_id").alias("source")).agg(F.min_by("text", "seg_idx").alias("text"), F.max("end_ms").alias("duration_ms"))
    return segments.fallback(t).select("session_id", "source", "start_ms", "end_ms", "text")


@query
def session_json(spark, sf):
    """Sources, length and number of segments of each session's JSON document, read back from it."""
    s = D.seg(spark, sf).withColumn("position", F.col("seg_idx")).withColumn("speaker_name", F.lit(None).cast("string"))
    doc = F.from_json("json", "struct<backend:string,duration_seconds:double,sources:array<string>,segments:array<struct<start_time:double,text:string>>>")
    out = render.transcript_json(s).select("session_id", doc.alias("d"))
    return out.select("session_id", "d.backend", "d.duration_seconds", F.array_join("d.sources", "+").alias("sources"), F.size("d.segments").cast("long").alias("segments"), F.round(F.aggregate("d.segments", F.lit(0.0), lambda t, x: t + x["start_time"]), 3).alias("starts"))


@query
def backend_names(spark, sf):
    h = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.substring_index("o_orderpriority", "-", -1).alias("backend"))
    return render.backends(h)


@query
def speaker_order(spark, sf):
    """Speakers of a session in both orders: by useful speech, and with numbers first."""
    s = D.seg(spark, sf).withColumn("speaker_id", F.when(F.col("seg_idx") % 3 == 0, F.col("speaker_id")).otherwise((F.col("seg_idx") % 12).cast("string")))
    by = W.partitionBy("session_id")
    return speakers.summary(s).select("session_id", "speaker_id", F.row_number().over(by.orderBy(*speakers.summary_order())).cast("long").alias("by_speech"), F.row_number().over(by.orderBy(*speakers.numeric_order())).cast("long").alias("by_number"))


# --- intervals ---------------------------------------------------------------------------------------------------------


@query
def range_clip(spark, sf):
    clips = intervals.clip(D.seg(spark, sf), ranges(spark, RANGES), ["source"])
    return clips.groupBy("session_id", "speaker_id").agg(F.count("*").alias("pieces"), F.sum(F.col("clip_end_ms") - F.col("clip_start_ms")).alias("clipped_ms"))


@query
def overlap_relabel(spark, sf):
    s = D.seg(spark, sf).where("speaker_id = 'click'").withColumn("speaker_name", F.lit(None).cast("string"))
    return intervals.relabel(s, ranges(spark, RANGES), ["source"], "Ana").where("speaker_name is not null").select("session_id", "seg_idx", "start_ms", "end_ms", "speaker_name")


@query
def relabelled_outputs(spark, sf):
    """Files that a relabelling of all speakers within the ranges writes, with the digest of the text."""
    out = flows.relabel_outputs(flows.relabelled(D.seg(spark, sf), ranges(spark, RANGES), ["source"], "Ana"))
    digest = F.when(F.col("name") == "transcript.md", F.sha2(F.encode("content", "UTF-8"), 256))
    return out.select("session_id", "name", "changed", digest.alias("text_sha256"), (F.get_json_object("content", "$.segments[0].speaker_name")).alias("first_name"))


@query
def selected_ranges(spark, sf):
    s = D.seg(spark, sf)
    r = ranges(spark, RANGES)
    chosen = intervals.clip(s, r, ["source"]).select("session_id", "speaker_id", F.col("clip_start_ms").alias("start_ms"), F.col("clip_end_ms").alias("end_ms"))
    asked = s.select("session_id", "speaker_id", "source").distinct().join(r, "source")
    m = clips.range_metadata(chosen, asked)
    return m.select("session_id", "speaker_id", F.col("selected_segments").alias("segments"), F.col("selected_seconds").alias("seconds"), F.size("requested_ranges").cast("long").alias("requested"))


@query
def clip_tokens(spark, sf):
    """Names of the clips that each segment's speaker would get for the segment's range."""
    s = D.seg(spark, sf)
    r = F.array(F.struct("start_ms", "end_ms"), F.struct(F.col("end_ms").alias("start_ms"), (F.col("end_ms") + F.col("seg_idx") % 1000).alias("end_ms")))
    norm = F.col("seg_idx") % 2 == 0
    sample = F.col("seg_idx") % 3 * 1500
    token = clips.request_token(F.col("speaker_id"), F.col("source"), r, sample, norm)
    return s.select("seg_idx", clips.sample_name(F.col("speaker_id"), token, norm).alias("sample"), clips.clip_name(F.col("speaker_id"), sample, norm).alias("clip"))


@query
def audio_by_source(spark, sf):
    s = D.seg(spark, sf).select("session_id", "seg_idx", "source")
    k = F.col("session_id") % 4
    files = s.select("session_id").distinct().select("session_id", F.explode(F.when(k == 0, F.array(F.lit("Mic"), F.lit("system"))).when(k == 1, F.array(F.lit("SYSTEM"))).when(k == 2, F.array(F.lit("room"), F.lit("mic"))).otherwise(F.array().cast("array<string>"))).alias("source"))
    files = files.withColumn("ordinal", F.when(F.col("source").isin("Mic", "room", "SYSTEM"), 0).otherwise(1)).withColumn("path", F.concat_ws("/", "session_id", "source"))
    return clips.audio_for_source(s, files).select("session_id", "seg_idx", "audio_path")


@query
def labels_before(spark, sf):
    s = D.seg(spark, sf).withColumn("speaker_name", F.when(F.col("seg_idx") % 3 == 0, F.upper("speaker_id")))
    return speakers.names_before(s).select("session_id", joined("labels"))


@query
def cap_duration(spark, sf):
    r = intervals.speaker_ranges(D.seg(spark, sf))
    return intervals.cap(r, 120_000).select("session_id", "speaker_id", "seg_idx", "start_ms", "end_ms")


@query
def speech_midpoint(spark, sf):
    return intervals.timestamps(intervals.speaker_ranges(D.seg(spark, sf), useful_only=True))


@query
def purity_windows(spark, sf):
    return intervals.purity_windows(intervals.speaker_ranges(D.seg(spark, sf), useful_only=True))


@query
def equal_speech_windows(spark, sf):
    return intervals.equal_speech_windows(intervals.speaker_ranges(D.seg(spark, sf)), 2).withColumn("window", F.col("window").cast("long"))


@query
def safety_audit(spark, sf):
    return speakers.audit(D.seg(spark, sf)).select("session_id", "speaker_id", "segments", "useful_segments", "useful_speech_ms", "first_ms", "middle_half_ms", "last_ms", "span_ms", "status", "safe", joined("reasons"))


@query
def audit_join_list(spark, sf):
    s = D.seg(spark, sf).withColumn("speaker_name", F.when((F.col("session_id") % 2 == 0) & (F.col("speaker_id") == "click"), "Ana"))
    return speakers.listing(s, speakers.audit(s), unnamed_only=True).select("session_id", "speaker_id", "segments", "useful_speech_ms", "status", "safe")


@query
def enrolment_guard(spark, sf):
    s = D.seg(spark, sf)
    audited = speakers.audit(s.where("source = 'mic'"))
    return speakers.guard(s.select("session_id", "speaker_id").distinct(), audited).select("session_id", "speaker_id", "decision", "reason")


@query
def all_clusters_safe(spark, sf):
    return speakers.all_safe(speakers.audit(segments.useful(D.seg(spark, sf)), ratio=20.0))


# --- labels and chunks -------------------------------------------------------------------------------------------------


@query
def forward_fill_speaker(spark, sf):
    s = D.seg(spark, sf)
    known = s.withColumn("speaker_id", F.when(segments.clusterable(5000), F.col("speaker_id")))
    return speakers.fill_labels(known).select("session_id", "seg_idx", "assigned_id")


@query
def first_appearance_labels(spark, sf):
    return speakers.sequential_labels(D.seg(spark, sf)).select("session_id", "seg_idx", "speaker_id", "label_no")


@query
def chunk_windows(spark, sf):
    s = D.seg(spark, sf).groupBy("session_id").agg(F.max("end_ms").alias("duration_ms"))
    return chunks.windows(s).select("session_id", "chunk_idx", "chunk_start_ms", "chunk_end_ms")


def chunked(spark, sf) -> DataFrame:
    step = chunks.LENGTH_MS - chunks.OVERLAP_MS
    return D.seg(spark, sf).withColumn("chunk_idx", F.floor(F.col("start_ms") / step)).withColumn("chunk_start_ms", F.col("chunk_idx") * step)


@query
def boundary_dedup(spark, sf):
    return chunks.boundary_dedup(chunked(spark, sf), exact=True).select("session_id", "chunk_idx", "seg_idx", "start_ms", "text")


@query
def merged_chunks(spark, sf):
    """Chunks put together on the recording's clock, in order of starts; a missing one counts as 0."""
    c = chunked(spark, sf).withColumns({"start_ms": F.when(F.col("seg_idx") % 10 != 0, F.col("start_ms") - F.col("chunk_start_ms")), "end_ms": F.when(F.col("seg_idx") % 10 != 0, F.col("end_ms") - F.col("chunk_start_ms"))})
    c = c.withColumn("text", F.concat(F.col("text"), F.lit(" "), F.col("seg_idx").cast("string")))
    return flows.merge_chunks(c, exact=True).select("session_id", "chunk_idx", "seg_idx", "start_ms", "position")


@query
def track_offsets(spark, sf):
    """How many speakers the first track has, where the second one's numbers begin."""
    s = D.seg(spark, sf).where("source = 'mic'")
    known = s.withColumn("speaker_id", F.when(segments.clusterable(5000), F.col("speaker_id")))
    return cluster.track_offsets(speakers.fill_labels(known))


@query
def boundary_dedup_fuzzy(spark, sf):
    s = chunked(spark, sf).withColumn("text", F.concat(F.col("text"), F.lit(" event"), F.when(F.col("seg_idx") % 2 == 0, "s").otherwise("")))
    return chunks.boundary_dedup(s).select("session_id", "chunk_idx", "seg_idx", "start_ms", "text")


@query
def fuzzy_dup_pairs(spark, sf):
    """Different names of parts of one brand that are alike by matching blocks of letters, by an index of their letters."""
    names = D.table(spark, sf, "part").select("p_brand", T.match_key(F.col("p_name")).alias("k"))
    return fuzzy.alike_pairs(names, 0.7, "p_brand").withColumn("ratio", F.round("ratio", 6))


# --- embeddings --------------------------------------------------------------------------------------------------------


def matches(spark, sf) -> DataFrame:
    return matching.best(D.candidates(spark, sf), D.profiles(spark, sf), THRESHOLD, MARGIN)


@query
def cosine_match(spark, sf):
    return matches(spark, sf).select("candidate_id", "profile_id", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "status")


@query
def skipped_profiles(spark, sf):
    p = D.profiles(spark, sf)
    k = F.pmod("profile_id", F.lit(4))
    odd = p.withColumns({"provider": F.when(k == 0, "other").otherwise(F.col("provider")), "embedding": F.when(k == 1, F.array().cast("array<double>")).when(k == 2, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))})
    return matching.skipped(D.candidates(spark, sf), odd).select("provider", "model", "dimension", "candidates", "profile_id", "reason")


@query
def label_resolution(spark, sf):
    m = matches(spark, sf).select((F.col("candidate_id") % 20).alias("session_id"), F.col("candidate_id").alias("speaker_id"), (F.col("candidate_id") % 9 != 0).alias("extracted"), "profile_id", "display_name", "confidence", "margin", "status")
    out = matching.resolve(m.withColumn("speaker_id", F.lpad(F.col("speaker_id").cast("string"), 8, "0")))
    return out.select("session_id", "speaker_id", "label", "profile_id", F.round("confidence", 6).alias("confidence"), "status")


def session_matches(spark, sf) -> DataFrame:
    m = matches(spark, sf)
    return m.select((F.col("candidate_id") % 20).alias("session_id"), F.lpad(F.col("candidate_id").cast("string"), 8, "0").alias("speaker_id"), "profile_id", "display_name", "confidence", "status")


@query
def duplicate_groups(spark, sf):
    return matching.duplicate_groups(session_matches(spark, sf)).select("session_id", "profile_id", "clusters", joined("speaker_ids"), F.round("best_confidence", 6).alias("best_confidence"))


def window_matches(spark, sf) -> DataFrame:
    m = matches(spark, sf)
    return m.select(F.lit(0).alias("session_id"), F.floor(F.col("candidate_id") / 5).alias("speaker_id"), "profile_id", "display_name", "status")


@query
def mixed_windows(spark, sf):
    return matching.mixed_clusters(window_matches(spark, sf)).select("speaker_id", joined("profile_ids"), joined("names"))


@query
def label_suggestions(spark, sf):
    return matching.suggestions(session_matches(spark, sf)).select("session_id", "speaker_id", "profile_id", "status", "recommendation")


@query
def suggestion_summary(spark, sf):
    m = session_matches(spark, sf)
    return matching.suggestion_summary(m, matching.duplicate_groups(m), matching.mixed_clusters(window_matches(spark, sf)))


def clustered(spark, sf) -> DataFrame:
    v = D.vectors(spark, sf)
    return v.select((F.col("vec_id") % 10).alias("session_id"), F.col("vec_id").alias("seg_idx"), F.col("label").cast("string").alias("cluster"), (F.col("vec_id") % 7 * 1000 + F.col("label") * 900).alias("duration_ms"), "embedding")


@query
def centroid_nearest(spark, sf):
    return cluster.nearest_large(clustered(spark, sf), 30_000).select("session_id", "cluster", "target", F.round("similarity", 6).alias("similarity"))


@query
def agglomerative(spark, sf):
    rows = clustered(spark, sf).withColumn("session_id", F.floor(F.col("seg_idx") / 100)).select("session_id", "seg_idx", "embedding")
    return cluster.cluster(rows, distance=0.85).select("session_id", "seg_idx", "cluster")


@query
def merged_clusters(spark, sf):
    return cluster.merge_tiny(clustered(spark, sf), 30_000).select("session_id", "seg_idx", "cluster")


def asked_names(spark, sf) -> DataFrame:
    """Names to look up: those of suppliers, some in other case and with blanks, and customers' segments."""
    n = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("request_id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("  "), F.upper("s_name"), F.lit(" "))).otherwise(F.col("s_name")).alias("name"))
    return n.unionByName(D.table(spark, sf, "customer").select((-F.col("c_custkey")).alias("request_id"), F.lower("c_mktsegment").alias("name")))


def enrolled(spark, sf) -> DataFrame:
    """Every second supplier under its own name, and every seventh customer under its segment's, as profiles."""
    s = D.table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("profile_id"), F.col("s_name").alias("display_name"))
    return s.unionByName(D.table(spark, sf, "customer").where("c_custkey % 7 = 0").select((F.col("c_custkey") + 1_000_000_000).alias("profile_id"), F.col("c_mktsegment").alias("display_name")))


@query
def profile_lookup(spark, sf):
    return matching.profile_by_name(asked_names(spark, sf), enrolled(spark, sf)).select("request_id", "status", "profile_id")


@query
def names_taken(spark, sf):
    return matching.name_taken(asked_names(spark, sf), enrolled(spark, sf).select("display_name").distinct()).select("request_id")


@query
def enrolment_outcomes(spark, sf):
    r = asked_names(spark, sf).withColumns({"selected_seconds": (F.abs(F.col("request_id")) % 4).cast("double"), "error": F.when(F.abs(F.col("request_id")) % 5 == 0, "no audio")})
    return clips.enrolment_outcome(r, enrolled(spark, sf)).select("request_id", "outcome")


def profile_table(spark, sf) -> DataFrame:
    c = D.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.col("c_mktsegment"), F.lit(" "), (F.col("c_custkey") % 120).cast("string")).alias("displayName"), F.lit("t0").alias("createdAt"), F.lit("t0").alias("updatedAt"), F.lit("bands").alias("embeddingProvider"), F.lit("v1").alias("embeddingModel"), F.array(F.col("c_acctbal").cast("double")).alias("embedding"))


@query
def profile_listing(spark, sf):
    """The index in order, after names were changed and profiles removed; the order comes as a rank among equal first letters."""
    p = profile_table(spark, sf)
    ids = p.select("id", F.col("id").cast("long").alias("k"))
    p = transcripts.rename(p, ids.where("k % 5 = 0").select("id", F.lit("zoe 7").alias("new_name")), F.lit("t1"))
    p = transcripts.index_of(transcripts.remove(p, ids.where("k % 11 = 0").select("id")))
    place = W.partitionBy(F.lower(F.substring("displayName", 1, 1))).orderBy(transcripts.name_order(F.col("displayName")), "displayName", "id")
    return p.select("id", "displayName", "updatedAt", F.row_number().over(place).cast("long").alias("place"))


def tentative(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(vectors, segments) of clusters that each stand for a vector, one to three segments each."""
    v = D.candidates(spark, sf).withColumn("key", F.lpad(F.col("candidate_id").cast("string"), 8, "0"))
    seconds = F.col("candidate_id") % 7 + 1
    rows = v.select((F.col("candidate_id") % 20).alias("session_id"), F.col("key").alias("speaker_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("candidate_id") % 3)).alias("seg_idx"), seconds.alias("_s"))
    rows = rows.select("session_id", "speaker_id", "seg_idx", F.lit("mic").alias("source"), (F.col("seg_idx") * 10_000).alias("start_ms"), (F.col("seg_idx") * 10_000 + F.col("_s") * 1000).alias("end_ms"), F.lit("words").alias("text"))
    return v, rows


def looked_up(v: DataFrame) -> flows.Extract:
    """A hook in place of audio: a cluster's embedding is its vector, and a later window's that of the candidate 20 further on, if there is one."""

    def hook(asked: DataFrame) -> DataFrame:
        of = v.select(F.col("key").alias("_key"), "provider", "model", "embedding")
        later = F.lpad((F.col("speaker_id").cast("long") + 20 * (F.col("window") - 1)).cast("string"), 8, "0") if "window" in asked.columns else F.col("speaker_id")
        short = F.lit(False) if "window" in asked.columns else F.col("speech_ms") < 8000
        return asked.withColumn("_key", later).join(of, "_key").drop("_key").withColumn("extraction", F.when(short, "too_short").otherwise("ok"))

    return hook


@query
def suggested_labels(spark, sf):
    """The whole flow over clusters whose embeddings come from the vectors: a hook in place of audio."""
    v, rows = tentative(spark, sf)
    found = flows.suggest_labels(rows, D.profiles(spark, sf), looked_up(v), match=flows.by_score(THRESHOLD, MARGIN))
    return found["clusters"].select("session_id", "position", "speaker_id", "source", "segments", "speech_ms", "extraction", F.when(F.col("status") == "matched", F.col("profile_id")).alias("profile_id"), "status", "recommendation", "detail")


@query
def suggested_windows(spark, sf):
    """Clusters of whose two windows of equal speech the hook says that they are of different people, by the same flow."""
    v, rows = tentative(spark, sf)
    found = flows.suggest_labels(rows, D.profiles(spark, sf), looked_up(v), match=flows.by_score(THRESHOLD, MARGIN), n_windows=2)
    return found["mixed"].select("session_id", "speaker_id", joined("profile_ids"), joined("names"))


# --- samples -----------------------------------------------------------------------------------------------------------


@query
def loudness_band(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("track"), "event_id", "value")
    rows = e.withColumn("idx", F.row_number().over(W.partitionBy("track").orderBy("event_id")) - 1).withColumn("value", F.col("value") / 500.0)
    return pcm.speech_loudness(rows, 5).select("track", "frames", F.round("loudness", 6).alias("loudness"))


@query
def speech_gain(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").alias("track"), "event_id", (F.col("value") / 50000.0).alias("value"))
    rows = e.withColumn("idx", F.row_number().over(W.partitionBy("track").orderBy("event_id")) - 1)
    return pcm.speech_loudness(rows, 5).select("track", F.round(pcm.speech_gain(F.col("loudness")), 6).alias("gain"))


@query
def gated_rms_peak(spark, sf):
    s = D.samples(spark, sf)
    return s.groupBy("track").agg(F.round(pcm.gated_rms(F.col("value")), 6).alias("rms")).join(pcm.payload(s), "track")


def two_tracks(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = D.samples(spark, sf)
    rows = s.withColumn("half", F.col("event_id") % 2).withColumn("idx", F.row_number().over(W.partitionBy("track", "half").orderBy("event_id")) - 1)
    return rows.where("half = 0").select("track", "idx", "value"), rows.where("half = 1").select("track", "idx", "value")


@query
def mix_tracks(spark, sf):
    return pcm.mix(*two_tracks(spark, sf)).select("track", F.col("idx").cast("long").alias("idx"), "value")


@query
def mix_balanced(spark, sf):
    a, b = two_tracks(spark, sf)
    return pcm.mix(a, b.withColumn("value", F.floor(F.col("value") / 7)), balanced=True).groupBy("track").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max(F.abs("value")).alias("peak"))


@query
def track_drift(spark, sf):
    a, b = (t.groupBy("track").agg((F.count("*") / 4.0).alias("duration_s")) for t in two_tracks(spark, sf))
    return pcm.drift(a, b, "track")


def arrays(spark, sf) -> DataFrame:
    s = D.samples(spark, sf)
    return s.groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("samples"))


@query
def resample_linear(spark, sf):
    return pcm.resample_rows(D.samples(spark, sf), 4, 6)


@query
def float_to_int16(spark, sf):
    return D.table(spark, sf, "events").select("event_id", pcm.float_to_16((F.col("value") - 50) / 100).cast("long").alias("sample"))


@query
def interleaved(spark, sf):
    return pcm.interleave_rows(list(two_tracks(spark, sf)))


def with_energy(spark, sf) -> DataFrame:
    """Ranges of speakers, scored by the energy of their user's samples: four a second from the place of the range in its track."""
    r = intervals.speaker_ranges(D.seg(spark, sf)).withColumn("first", F.col("start_ms") % 40)
    s = D.samples(spark, sf).select(F.col("track").alias("session_id"), "idx", "value")
    count = F.greatest(F.floor((F.col("end_ms") - F.col("start_ms")) / 4000), F.lit(1))
    found = pcm.energy_of_ranges(r.withColumn("last", F.col("first") + count), pcm.energy_blocks(s, "session_id", 64), "session_id", 64)
    return found.drop("first", "last").withColumnRenamed("energy", "score")


@query
def energy_topk(spark, sf):
    r = with_energy(spark, sf).withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    return intervals.best_energy(r, 90_000).select("session_id", "speaker_id", "seg_idx", "start_ms", "end_ms", "score")


@query
def range_samples(spark, sf):
    """Samples of several ranges of each track in their order: two clips, one of them of nothing."""
    piece = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    ranges_ = F.array(piece(2.0, 3.6), piece(1.0, 1.0), piece(0.25, 1.75), piece(5.0, 1000.0))
    cut = arrays(spark, sf).select("track", F.posexplode(pcm.concat_ranges(F.col("samples"), ranges_, 4)).alias("idx", "value"))
    return cut.select("track", F.col("idx").cast("long").alias("idx"), "value")


@query
def normalized_speech(spark, sf):
    s = D.samples(spark, sf).withColumn("value", F.floor(F.col("value") / 50))
    return pcm.normalize_speech(s.select("track", "idx", "value"), 5).groupBy("track").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max(F.abs("value")).alias("peak"))


@query
def mono_tracks(spark, sf):
    a = arrays(spark, sf).select("track", F.posexplode(pcm.mono(F.col("samples"), 2)).alias("idx", "floored"), pcm.mono(F.col("samples"), 2, truncate=True).alias("_t"))
    return a.select("track", F.col("idx").cast("long").alias("idx"), "floored", F.get("_t", F.col("idx")).alias("cut"))


@query
def band_features(spark, sf):
    return pcm.band_rows(D.samples(spark, sf)).withColumn("feature", F.round("feature", 6))


# --- catalogue ---------------------------------------------------------------------------------------------------------


@query
def meeting_now(spark, sf):
    s = D.seg(spark, sf)
    events = s.select("session_id", F.col("seg_idx").alias("event_id"), F.col("start_ms").alias("start_s"), F.col("end_ms").alias("end_s"), (F.col("seg_idx") % 13 == 0).alias("is_all_day"))
    now = s.select("session_id").distinct().withColumn("now_s", F.lit(1_200_000).cast("long"))
    return catalog.select_meeting(events, now, 60_000, "session_id")


@query
def timeout_by_session(spark, sf):
    files = D.seg(spark, sf).select("session_id", ((F.col("end_ms") - F.col("start_ms")) / 100.0).alias("duration_s"))
    return catalog.timeouts(files)


@query
def board_lanes(spark, sf):
    return catalog.lane_counts(D.sessions(spark, sf))


@query
def board_cards(spark, sf):
    """Orders as sessions in all statuses, with times in both forms, reasons and process numbers here and there."""
    k = F.col("session_id")
    statuses = F.array(*[F.lit(x) for x in (*T.LANES, "odd")])
    day = F.col("started_at")
    human = lambda c: F.when(k % c == 0, F.concat(F.lit("on "), day))
    s = D.sessions(spark, sf).withColumns({
        "status": F.get(statuses, (k % 10).cast("int")), "session_dir": F.concat(F.lit("/vault/recordings/"), k.cast("string")), "title": F.when(k % 17 != 0, F.concat("title", F.lit(" | a]]"))),
        "ended_at": day, "ended_at_human": human(2), "started_at_human": human(3), "scheduled_start_at": day, "failed_at": F.when(k % 3 == 0, day), "failed_at_human": human(7), "cancelled_at": day, "interrupted_at": F.when(k % 4 == 1, day),
        "transcribed_at": day, "transcribed_at_human": human(5), "transcription_started_at": day, "transcription_pid": F.when(k % 2 == 1, k), "failure_reason": F.when(k % 5 != 0, "no audio"), "cancel_reason": F.when(k % 7 == 0, "too late"), "mode": F.when(k % 6 != 0, "meeting"),
    })
    return catalog.board(s, "/vault").select("lane", F.col("place").cast("long").alias("place"), "session_id", "card")


def session_changes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Sessions and a change for most of them: some out of order, some of another run."""
    s, k = D.sessions(spark, sf).withColumns({"run_id": F.when(F.col("session_id") % 3 != 0, "r1"), "transcription_pid": F.lit("77")}), F.col("session_id")
    statuses = F.array(*map(F.lit, ("transcribing", "transcribed", "transcription_failed", "transcription_interrupted", "recording")))
    return s, s.where(k % 4 != 0).select("session_id", F.get(statuses, (k % 5).cast("int")).alias("status"), F.lit("1999-01-01").alias("at"), F.lit("no audio").alias("reason"), F.when(k % 7 != 0, F.when(k % 6 == 1, "r2").otherwise("r1")).alias("run_id"), F.when(k % 9 == 0, "log").alias("log_path"))


@query
def marked_sessions(spark, sf):
    return catalog.mark(*session_changes(spark, sf)).select("session_id", "status", "refused", "failed_at", "failure_reason", "interrupted_at", "transcribed_at", "transcription_pid", "transcription_started_at", "transcription_log_path")


@query
def refused_transitions(spark, sf):
    return catalog.refused_transitions(session_events(spark, sf)).select("session_id", "event_id", "before", "status")


@query
def session_ends(spark, sf):
    s = D.sessions(spark, sf).select("session_id", F.when(F.col("session_id") % 3 == 0, F.col("started_at")).alias("ended_at"))
    files = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").cast("timestamp").alias("modified"))
    return catalog.session_end(s.join(files.select("session_id").distinct(), "session_id", "left_semi"), files).select("session_id", F.substring("ended_at", 1, 10).alias("ended_on"))


@query
def audio_choices(spark, sf):
    k = F.col("session_id")
    name = lambda x: F.concat(k.cast("string"), F.lit(x))
    s = D.sessions(spark, sf).select("session_id", name("/mic.wav").alias("mic"), name("/system.wav").alias("system"), F.when(k % 4 != 0, name("/mixed.wav")).alias("mixed"), F.when(k % 5 == 0, "rates differ").alias("mix_error"), (k % 50 / 4.0).alias("mic_s"), (k % 48 / 4.0).alias("system_s"))
    return catalog.audio_source(s).select("session_id", "audio", F.array_join("outputs", "|").alias("outputs"), "note", F.col("drift_note").isNotNull().alias("drifts"))


@query
def calendar_answers(spark, sf):
    """Orders as answers of a calendar, their lines as events; some orders have no answer, a wrong one, or an error."""
    day_of = lambda d: F.date_format(d, "yyyy-MM-dd")
    li = lines(spark, sf).select(F.col("l_orderkey").alias("answer_id"), F.struct("n", F.when(F.col("n") % 3 != 0, F.concat(F.lit("Line "), F.col("n").cast("string"))).alias("subject"), day_of("l_shipdate").alias("start"), day_of(F.date_add("l_shipdate", 1)).alias("end"), (F.col("n") == 2).alias("is_all_day")).alias("e"))
    k = F.col("answer_id")
    data = li.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e.dropFields("n")).alias("data"))
    good = F.to_json(F.struct(F.lit(True).alias("ok"), "data"))
    out = F.when(k % 7 == 3, "{oops").when(k % 7 == 4, '{"ok": false}').when(k % 7 == 5, '{"ok": false, "error": {"code": "no_login", "message": "x"}}').otherwise(good)
    answers = data.select("answer_id", F.when(k % 7 == 0, "missing").when(k % 7 == 1, "timeout").alias("outcome"), F.when(k % 7 == 2, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"), out.alias("stdout"))
    found = catalog.calendar_events(answers)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("answer_id", "error", F.col("event_no").cast("long").alias("event_no"), "subject", day("start"), day("end"), "is_all_day")


@query
def staged_runs(spark, sf):
    """Orders as staged runs, whole, with a file missing or empty, or with JSON of another shape."""
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    k = F.col("run_id")
    shapes = F.array(*map(F.lit, ('{"segments": []}', "[]", '{"segments": {}}', "{", '{"text": "x"}', '[{"text": "y"}]', "")))
    js = o.select("run_id", F.lit("transcript.json").alias("name"), F.get(shapes, (k % 7).cast("int")).alias("content")).where(k % 10 != 0)
    md = o.select("run_id", F.lit("transcript.md").alias("name"), F.when(k % 9 != 0, "words").otherwise("").alias("content")).where(k % 8 != 0)
    return catalog.staged_outputs(js.unionByName(md))


@query
def growing_files(spark, sf):
    li = lines(spark, sf).select(F.concat_ws("/", "l_orderkey", "n").alias("path"), (F.col("l_quantity") * 100).cast("long").alias("length"), F.col("l_returnflag"), F.col("l_linestatus"))
    return catalog.growing(li.where("l_returnflag <> 'A'").select("path", "length"), li.where("l_linestatus = 'O' OR l_returnflag = 'A'").select("path", (F.col("length") + F.length("path") % 2).alias("length")))


@query
def audio_lists(spark, sf):
    li = lines(spark, sf)
    names = F.array(*map(F.lit, ("system.wav", "mic.wav", "extra.wav", "mixed.wav", "a.wav")))
    files = li.select(F.col("l_orderkey").alias("session_id"), F.get(names, (F.col("n") % 5).cast("int")).alias("name"), (F.col("l_quantity") * 3).cast("long").alias("length")).groupBy("session_id", "name").agg(F.max("length").alias("length"))
    return catalog.audio_order(files).select("session_id", joined("audio_files"))


@query
def sounding_files(spark, sf):
    return catalog.has_sound(lines(spark, sf).select("l_orderkey", "n", (F.col("l_quantity") * 200).cast("long").alias("length")))


@query
def scheduled_starts(spark, sf):
    e = D.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("at", "HH:mm")).when(F.col("event_id") % 3 == 1, F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.lit("at "), F.date_format("at", "HH:mm")))
    r = e.withColumn("text", text)
    when = catalog.scheduled_start(F.col("text"), now)
    left = catalog.meeting_times(T.parse_iso(F.date_format("at", "yyyy-MM-dd HH:mm:ss")), when, now)
    return r.select("event_id", "text", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("starts"), T.time_token(when).alias("token"), left["starts_in_s"].alias("from_now_s"), left["ends_in_s"].alias("to_start_s"))


@query
def device_errors(spark, sf):
    c = D.table(spark, sf, "customer")
    words = F.array(*map(F.lit, ("network read timed out", "GPU Timeout Error", "memory card missing", "Resource exhausted", "failed to ALLOCATE", "Command buffer execution failed: out of memory", "fine")))
    r = c.select("c_custkey", F.concat(F.col("c_name"), F.lit(": "), F.get(words, (F.col("c_custkey") % 7).cast("int"))).alias("text"))
    return r.select("c_custkey", T.device_error(F.col("text")).alias("kind"))


@query
def pending_sessions(spark, sf):
    return catalog.newest(catalog.pending(D.sessions(spark, sf)), 20).select("session_id", "status", "started_at")


@query
def chosen_session(spark, sf):
    return catalog.choose(D.sessions(spark, sf)).select("session_id", "status", "started_at")


@query
def slug_titles(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", T.slug(F.concat(F.lit("  "), F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit("! "))).alias("slug"))


@query
def parse_ranges(spark, sf):
    """Ranges written in many ways, some of them wrong, from the lines of orders."""
    li = lines(spark, sf).select("l_orderkey", "n", F.col("l_quantity").cast("int").alias("q"), (F.col("l_partkey") % 100).cast("string").alias("p"), (F.col("l_suppkey") % 7).alias("k"))
    clock = F.concat(F.lpad((F.col("q") % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("q") % 50).cast("string"), 2, "0"))
    text = (
        F.when(F.col("k") == 0, F.concat("p", F.lit("-"), F.col("q").cast("string")))
        .when(F.col("k") == 1, F.concat(clock, F.lit("-1:"), clock))
        .when(F.col("k") == 2, F.concat(F.lit(" "), F.col("q").cast("string"), F.lit(".5 - "), clock, F.lit(" ")))
        .when(F.col("k") == 3, F.concat(F.lit("-"), F.col("p")))
        .when(F.col("k") == 4, F.concat(F.col("p"), F.lit("x-"), F.col("p")))
        .when(F.col("k") == 5, F.concat(F.lit("0:"), clock, F.lit("-")))
        .otherwise(F.concat(F.lit("00:"), clock, F.lit("-"), F.lit("01:00:"), F.lpad(F.col("p"), 2, "0"), F.lit(".25")))
    )
    r = li.withColumn("text", text).withColumn("range", T.parse_range(F.col("text")))
    return r.select("l_orderkey", "n", "text", F.col("range.start").alias("start_s"), F.col("range.end").alias("end_s"))


def people(spark, sf) -> DataFrame:
    """Lists of people from customers: bracketed addresses, bare ones, names alone, "Last, First <address>", empty entries."""
    c = D.table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    mail = F.concat(F.lit("c"), key, F.lit("@mail.example"))
    text = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.col("c_name"), F.lit(" <"), mail, F.lit(">  , "), F.col("c_mktsegment")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.col("c_mktsegment"), F.lit(", "), F.col("c_name"), F.lit("  < "), mail, F.lit(" >,"), mail, F.lit(",")))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit(" , "), mail, F.lit(", not@mail, "), F.col("c_name")))
        .otherwise(F.lit("  "))
    )
    return c.select("c_custkey", text.alias("text"))


@query
def attendee_lists(spark, sf):
    return people(spark, sf).select("c_custkey", F.posexplode(T.attendees(F.col("text"))).alias("pos", "a")).select("c_custkey", F.col("pos").cast("long").alias("pos"), "a.name", "a.address")


@query
def journal_decision(spark, sf):
    """Orders as journals, their lines as files: most were replaced, some only by the look of their hash, some not."""
    k = F.col("l_orderkey") * 7 + F.col("n")
    rows = lines(spark, sf).select(F.col("l_orderkey").alias("journal_id"), F.col("n").alias("name"), (k % 5 != 0).alias("existed"), (k % 11 < 9).alias("replaced"), (k % 3).cast("string").alias("new_sha256"), F.when(k % 13 != 0, (k % 6 % 3).cast("string")).alias("found_sha256"))
    return catalog.journal_action(rows).select("journal_id", "name", "action")


@query
def resume_decision(spark, sf):
    s = D.sessions(spark, sf).withColumns({"alive": F.col("session_id") % 4 == 0, "staged_valid": F.col("session_id") % 4 == 1, "legacy_valid": F.col("session_id") % 4 == 2, "legacy_at": F.lit("1995-01-01")})
    return catalog.resume_action(s).groupBy("status", "action").agg(F.count("*").alias("sessions"))


@query
def foreign_runs(spark, sf):
    s = D.sessions(spark, sf).select("session_id", (F.col("session_id") % 7).cast("string").alias("run_id"))
    owners = s.select("session_id", F.when(F.col("session_id") % 2 == 0, (F.col("session_id") % 5).cast("string")).alias("reserved_by"), F.when(F.col("session_id") % 3 == 0, (F.col("session_id") % 7).cast("string")).alias("metadata_run"))
    return catalog.foreign_runs(s, owners).select("session_id", "run_id")


def session_events(spark, sf) -> DataFrame:
    e = D.table(spark, sf, "events")
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv]), F.col("event_type"))
    return e.select(F.col("user_id").alias("session_id"), "event_id", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("at_ms"), status.alias("status"))


STATUS_OF = {"signup": "scheduled", "click": "recording", "view": "stopped", "purchase": "transcribed", "error": "transcription_failed"}


@query
def lifecycle_fold(spark, sf):
    states = catalog.fold_status(session_events(spark, sf))
    return catalog.expire_scheduled(states, F.lit(2_600_000_000).cast("long")).select("session_id", "status", "at_ms", "events")


@query
def lifecycle_stream(spark, sf):
    from speechgrain.streaming import lifecycle

    return lifecycle.run_once(spark, sf)
