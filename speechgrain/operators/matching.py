"""Embedding matching: scores of candidates against profiles, decisions, label resolution and suggestions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechgrain.functions.vectors import cosine, norm

THRESHOLD, MARGIN = 0.78, 0.05


#: Profiles up to this many numbers in all their vectors are broadcast; others meet candidates dealt over ``SALTS`` parts.
BROADCAST_CELLS, SALTS = 4_000_000, 64


def scores(candidates: DataFrame, profiles: DataFrame, cells: int = BROADCAST_CELLS) -> DataFrame:
    """A row for each candidate and comparable profile: same provider and model, an embedding, equal length.

    ``candidates(candidate_id, provider, model, embedding)``, ``profiles(profile_id, display_name, provider, model,
    embedding)``. Provider and model are often the same for all rows, so a join on them would meet in one task: profiles are
    broadcast if their vectors have at most ``cells`` numbers, which is counted first; else they are repeated ``SALTS`` times,
    and candidates are dealt over the copies. Norms are taken once a row, before the join.
    """
    c = candidates.where(F.size("embedding") > 0).select("candidate_id", "provider", "model", F.size("embedding").alias("_k"), F.col("embedding").alias("_a"), norm(F.col("embedding")).alias("_na"))
    p = profiles.where(F.size("embedding") > 0).select("profile_id", "display_name", "provider", "model", F.size("embedding").alias("_k"), F.col("embedding").alias("_b"), norm(F.col("embedding")).alias("_nb"))
    keys = ["provider", "model", "_k"]
    if (profiles.agg(F.sum(F.greatest(F.size("embedding"), F.lit(1)))).first()[0] or 0) <= cells:
        pairs = c.join(F.broadcast(p), keys)
    else:
        salted = p.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = c.withColumn("_salt", F.pmod(F.xxhash64("candidate_id"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"])
    return pairs.select("candidate_id", "profile_id", "display_name", cosine(F.col("_a"), F.col("_b"), F.col("_na"), F.col("_nb")).alias("score"))


#: Rows of a block of profiles or candidates that meet as one product of matrices.
BLOCK = 4096
KEYS = ("provider", "model", "_k")


def _top_two(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the best of ``theirs`` for each of ``mine``, its cosine, the next cosine or NaN); ties go to the earlier row.

    Cosines are compared by twelve digits, for the products of equal vectors may differ in the last ones. A zero vector has cosine 0.
    """
    size = lambda x: np.linalg.norm(x, axis=1)
    scores = mine @ theirs.T
    lengths = size(mine)[:, None] * size(theirs)[None, :]
    scores = np.divide(scores, lengths, out=np.zeros_like(scores), where=lengths > 0)
    coarse = scores.round(12)
    first = coarse.argmax(axis=1)
    every = np.arange(len(mine))
    coarse[every, first] = -np.inf
    second = coarse.argmax(axis=1)
    return first, scores[every, first], scores[every, second] if theirs.shape[0] > 1 else np.full(len(mine), np.nan)


def _usable(rows: DataFrame) -> DataFrame:
    """Rows with an embedding of numbers, and its length as ``_k``."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return rows.where((F.size("embedding") > 0) & whole).withColumn("_k", F.size("embedding")).withColumn("embedding", F.col("embedding").cast("array<double>"))


def _packed(rows: DataFrame, ident: str, names: list[str], block: int) -> DataFrame:
    """``rows`` as blocks of about ``block`` of a class: (provider, model, _k, _block, _blocks, the rows in order of ``ident``)."""
    sizes = rows.groupBy(*KEYS).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    dealt = rows.join(F.broadcast(sizes), list(KEYS)).withColumn("_block", F.pmod(F.xxhash64(ident), F.col("_blocks")).cast("int"))
    return dealt.groupBy(*KEYS, "_blocks", "_block").agg(F.array_sort(F.collect_list(F.struct(ident, *names, "embedding"))).alias("_rows"))


def _by_blocks(c: DataFrame, p: DataFrame, kinds: tuple[str, str], block: int) -> DataFrame:
    """``(candidate_id, profile_id, display_name, score, next)``: the best two of each block of profiles, for profiles of any number."""
    mine, theirs = _packed(c, "candidate_id", [], block), _packed(p, "profile_id", ["display_name"], block)
    left = mine.select(*KEYS, F.col("_block").alias("_i"), F.col("_blocks").alias("_ni"), F.col("_rows").alias("_a"))
    right = theirs.select(*KEYS, F.col("_block").alias("_j"), F.col("_blocks").alias("_nj"), F.col("_rows").alias("_b"))
    of = lambda rows, n: F.broadcast(rows.select(*KEYS, n).distinct())  # noqa: E731  # a row for each class
    left = left.join(of(right, "_nj"), list(KEYS)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nj") - 1))).drop("_nj")
    right = right.join(of(left, "_ni"), list(KEYS)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_ni") - 1))).drop("_ni")
    pairs = left.drop("_ni").join(right.drop("_nj"), [*KEYS, "_i", "_j"]).select(F.col("_a.candidate_id").alias("c"), F.col("_a.embedding").alias("x"), F.col("_b.profile_id").alias("p"), F.col("_b.display_name").alias("n"), F.col("_b.embedding").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c_, x, p_, n, y in batch.itertuples(index=False):
                at, score, second = _top_two(np.stack(x), np.stack(y))
                yield pd.DataFrame({"candidate_id": c_, "profile_id": np.asarray(p_)[at], "display_name": np.asarray(n)[at], "score": score, "next": second})

    return pairs.mapInPandas(run, f"candidate_id {kinds[0]}, profile_id {kinds[1]}, display_name string, score double, next double")


def _by_broadcast(c: DataFrame, p: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    """The same for profiles that fit in a broadcast: every batch of candidates meets them where it lies, nothing is shuffled."""
    classes: dict[tuple, list] = {}
    for r in p.select(*KEYS, "profile_id", "display_name", "embedding").orderBy("profile_id").collect():
        classes.setdefault((r.provider, r.model, r["_k"]), []).append((r.profile_id, r.display_name, r.embedding))
    known = {k: (np.array([i for i, _, _ in v], object), np.array([n for _, n, _ in v], object), np.array([e for _, _, e in v])) for k, v in classes.items()}
    shared = c.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(list(KEYS), sort=False):
                if key in shared.value:
                    ids, names, theirs = shared.value[key]
                    for k in range(0, len(part), BLOCK):
                        some = part.iloc[k : k + BLOCK]
                        at, score, second = _top_two(np.stack(some["embedding"].to_numpy()), theirs)
                        yield pd.DataFrame({"candidate_id": some["candidate_id"].to_numpy(), "profile_id": ids[at], "display_name": names[at], "score": score, "next": second})

    return c.select("candidate_id", *KEYS, "embedding").mapInPandas(run, f"candidate_id {kinds[0]}, profile_id {kinds[1]}, display_name string, score double, next double")


def best(candidates: DataFrame, profiles: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, cells: int = BROADCAST_CELLS, block: int = BLOCK) -> DataFrame:
    """The best profile of each candidate with its margin over the runner-up (the score itself without one) and a status.

    Only profiles of a candidate's provider, model and dimension count; candidates without any have no row. Ties go to the lower
    profile id. Scores are products of matrices, and of a block only the best and the next of each candidate leave the task; where profiles
    come in several blocks, these are merged by candidate. Profiles of up to ``cells`` numbers are broadcast. Rows without provider
    or model match nothing, nor do vectors with null or NaN components.
    """
    c = _usable(candidates).where("provider is not null and model is not null").select("candidate_id", *KEYS, "embedding")
    p = _usable(profiles).where("provider is not null and model is not null").select("profile_id", "display_name", *KEYS, "embedding")
    kinds = dict(candidates.dtypes)["candidate_id"], dict(profiles.dtypes)["profile_id"]
    if (profiles.agg(F.sum(F.greatest(F.size("embedding"), F.lit(1)))).first()[0] or 0) <= cells:
        tops = _by_broadcast(c, p, kinds)
    else:
        found = _by_blocks(c, p, kinds, block).withColumn("next", F.nanvl("next", F.lit(None)))
        order = F.struct((-F.round("score", 12)).alias("s"), F.col("profile_id"))
        # of the best of each block the overall best leads; the next is the second of all that the blocks gave
        scores_ = F.array_sort(F.filter(F.flatten(F.collect_list(F.array("score", "next"))), lambda x: x.isNotNull()), lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0))
        tops = found.groupBy("candidate_id").agg(F.min_by(F.struct("profile_id", "display_name", "score"), order).alias("_b"), F.get(scores_, F.lit(1)).alias("next")).select("candidate_id", "_b.*", "next")
    gap = F.col("score") - F.coalesce(F.nanvl("next", F.lit(None)), F.lit(0.0))
    status = F.when(F.col("score") < threshold, "below_threshold").when(gap < margin, "ambiguous").otherwise("matched")
    return tops.select("candidate_id", "profile_id", "display_name", F.col("score").alias("confidence"), gap.alias("margin"), status.alias("status"))


def skipped(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles that can't be compared with candidates, and why, for each class of candidates.

    What a profile is skipped for depends on the candidate's provider, model and dimension alone. So the result has a row for
    each profile and class, with the number of candidates, instead of each pair; classes are few, and are counted first.
    """
    c = candidates.where(F.size("embedding") > 0).groupBy(F.col("provider").alias("_p"), F.col("model").alias("_m"), F.size("embedding").alias("_n")).agg(F.count("*").alias("_candidates"))
    classes = F.array_sort(F.collect_list(F.struct(F.col("_p").alias("provider"), F.col("_m").alias("model"), F.col("_n").alias("dimension"), F.col("_candidates").alias("candidates"))))
    all_ = c.agg(classes.alias("c")).first()["c"]
    known = F.array(*[F.struct(F.lit(x.provider).alias("provider"), F.lit(x.model).alias("model"), F.lit(x.dimension).alias("dimension"), F.lit(x.candidates).cast("long").alias("candidates")) for x in all_])
    if not all_:
        known = F.array().cast("array<struct<provider:string,model:string,dimension:int,candidates:bigint>>")
    p = profiles.select("profile_id", "display_name", F.col("provider").alias("_p"), F.col("model").alias("_m"), F.coalesce(F.size("embedding"), F.lit(0)).alias("_k"), F.explode(known).alias("_c"))
    same = F.col("_c.provider").eqNullSafe(F.col("_p")) & F.col("_c.model").eqNullSafe(F.col("_m"))
    reason = F.when(~same, "provider_model_mismatch").when(F.col("_k") <= 0, "missing_embedding").when(F.col("_k") != F.col("_c.dimension"), "embedding_dimension_mismatch")
    return p.withColumn("reason", reason).where("reason is not null").select("_c.*", "profile_id", "display_name", "reason")


def skipped_of(candidates: DataFrame, skipped_: DataFrame) -> DataFrame:
    """``(candidate_id, profile_id, reason)`` of some candidates (a session's) from the classes of ``skipped``."""
    c = candidates.where(F.size("embedding") > 0).select("candidate_id", "provider", "model", F.size("embedding").alias("dimension"))
    return c.join(skipped_, ["provider", "model", "dimension"]).select("candidate_id", "profile_id", "reason")


def resolve(speakers: DataFrame, has_profiles: bool = True) -> DataFrame:
    """Final labels of a session's speakers.

    ``speakers(session_id, speaker_id, extracted, profile_id, display_name, confidence, margin, status)``: ``extracted`` tells
    whether an embedding could be made, ``status`` is the match's or null. A profile goes to its most confident speaker
    (ties to the lower id); the others become ``duplicate_profile_match``.
    """
    if not has_profiles:
        status = F.lit("no_profiles")
    else:
        status = F.when(~F.coalesce("extracted", F.lit(False)), "too_short").when(F.col("status").isNull(), "no_comparable_profiles").otherwise(F.col("status"))
    marked = speakers.withColumn("status", status)
    order = W.partitionBy("session_id", F.when(F.col("status") == "matched", F.col("profile_id"))).orderBy(F.desc("confidence"), "speaker_id")
    ranked = marked.withColumn("_r", F.row_number().over(order))
    lost = (F.col("status") == "matched") & F.col("profile_id").isNotNull() & (F.col("_r") > 1)
    out = ranked.withColumn("status", F.when(lost, "duplicate_profile_match").otherwise(F.col("status")))
    won, none = F.col("status") == "matched", F.lit(None)
    quiet = F.col("status").isin("no_profiles", "too_short", "no_comparable_profiles")
    return out.select(
        "session_id",
        "speaker_id",
        F.when(won, F.coalesce("display_name", F.concat(F.lit("Speaker "), F.col("speaker_id")))).otherwise(F.concat(F.lit("Speaker "), F.col("speaker_id"))).alias("label"),
        F.when(won, F.col("profile_id")).alias("profile_id"),
        F.when(quiet, none).otherwise(F.col("confidence")).alias("confidence"),
        F.when(quiet, none).otherwise(F.col("margin")).alias("margin"),
        "status",
    )


def suggestions(matches: DataFrame) -> DataFrame:
    """``matches(session_id, speaker_id, profile_id, display_name, confidence, status)`` with a recommendation each."""
    return matches.withColumn("recommendation", F.when(F.col("status") == "matched", "reuse_profile").otherwise("no_confident_match"))


def duplicate_groups(matches: DataFrame) -> DataFrame:
    """Profiles that two or more clusters of a session confidently match."""
    hit = matches.where("status = 'matched'").groupBy("session_id", "profile_id").agg(F.count("*").alias("clusters"), F.array_sort(F.collect_list("speaker_id")).alias("speaker_ids"), F.max("confidence").alias("best_confidence"))
    return hit.where("clusters >= 2")


def mixed_clusters(window_matches: DataFrame) -> DataFrame:
    """Clusters whose windows confidently match different profiles."""
    hit = window_matches.where("status = 'matched'").groupBy("session_id", "speaker_id").agg(F.array_sort(F.collect_set("profile_id")).alias("profile_ids"), F.array_sort(F.collect_set(F.nullif("display_name", F.lit("")))).alias("names"))
    return hit.where(F.size("profile_ids") >= 2)


def suggestion_summary(matches: DataFrame, duplicates: DataFrame, mixed: DataFrame, has_profiles: bool = True) -> DataFrame:
    """One row of counts; without profiles everything is unmatched."""
    matched = F.count_if(F.col("status") == "matched") if has_profiles else F.lit(0).cast("long")
    base = matches.agg(F.count("*").alias("cluster_count"), matched.alias("matched_count"))
    d, m = duplicates.agg(F.count("*").alias("duplicate_group_count")), mixed.agg(F.count("*").alias("mixed_cluster_count"))
    out = base.crossJoin(F.broadcast(d)).crossJoin(F.broadcast(m))  # one row each
    if not has_profiles:
        out = out.withColumns({"duplicate_group_count": F.lit(0).cast("long"), "mixed_cluster_count": F.lit(0).cast("long")})
    return out.withColumn("unmatched_count", F.col("cluster_count") - F.col("matched_count")).withColumn("status", F.lit("ok" if has_profiles else "no_profiles"))


def profile_by_name(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """``requests(name)`` -> not_found, ok with the profile's id, or ambiguous; names compare trimmed in lower case."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    p = profiles.groupBy(key("display_name").alias("_k")).agg(F.count("*").alias("_n"), F.min("profile_id").alias("_id"))
    out = requests.join(p, key("name") == F.col("_k"), "left")
    status = F.when(F.col("_n").isNull(), "not_found").when(F.col("_n") == 1, "ok").otherwise("ambiguous")
    return out.select(*requests.columns, status.alias("status"), F.when(F.col("_n") == 1, F.col("_id")).alias("profile_id"))


def name_taken(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests whose exact name, letter for letter, a profile has."""
    return requests.join(profiles.select(F.col("display_name").alias("name")), "name", "left_semi")
