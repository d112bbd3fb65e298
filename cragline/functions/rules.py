"""Rule tables of the reconciliation as column expressions; the first matching branch wins.

Fixed values: the labels and bounds of all rules below; results are compared by them. A null in a condition lets the
next branch decide; what a rule gives for rows that no branch takes stands as its default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR = ("EXACT_POS", "VERY_NEAR_POS", "NEAR_POS")
SEVERITIES = ["NO_DATA", "NONE", "MINOR", "REVIEW", "STRONG", "SEVERE"]


def branches(*pairs, default=None) -> Column:
    """CASE WHEN of (condition, value) pairs."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(pairs[0][0], lit(pairs[0][1]))
    for cond, value in pairs[1:]:
        out = out.when(cond, lit(value))
    return out.otherwise(lit(default))


def ladder(x: Column, steps: list[tuple[float, str]], above: str, missing: str | None = None) -> Column:
    """The label of the first bound that x does not exceed."""
    return branches((x.isNull(), missing), *[(x <= b, v) for b, v in steps], default=above)


def position_class(d: Column, exact: float = 15, near: float = 100, replay: float = 250) -> Column:
    return ladder(d, [(exact, "EXACT_POS"), (50, "VERY_NEAR_POS"), (near, "NEAR_POS"), (replay, "RIDGE_OFFSET")], "REMOTE_OFFSET")


def height_class(diff: Column) -> Column:
    return ladder(diff, [(10, "DB_HEIGHT_OK"), (20, "DB_HEIGHT_MINOR_CONFLICT")], "DB_HEIGHT_MAJOR_CONFLICT")


def border_zone(d: Column) -> Column:
    return branches((d.isNull(), None), (d > 50, "INNER"), (d >= 0, "BORDER_ZONE"), default="OUTER")


def admin_context(national: Column, state: Column) -> Column:
    n, s = F.coalesce(national == "BORDER_ZONE", F.lit(False)), F.coalesce(state == "BORDER_ZONE", F.lit(False))
    return branches((n & s, "AT_AND_BL_BORDER"), (n, "AT_BORDER"), (s, "BL_BORDER"), default="INNER")


def admin_review(context: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")).isin("", "INNER"), 0).otherwise(1)


def raw_peak_zone(d: Column) -> Column:
    return ladder(d, [(100, "RAW_0_100"), (300, "RAW_100_300"), (600, "RAW_300_600")], "RAW_GT_600", "NO_RAW_PEAK")


def bev_support(z_als: Column, z_bev: Column, db: Column) -> Column:
    a, b = F.abs(z_bev - z_als), F.abs(z_bev - db)
    return branches((z_als.isNull() | z_bev.isNull() | db.isNull(), "NO_BEV_AT_CALC_POINT"), (F.abs(a - b) <= 0.5, "BEV_EQUAL"), (a < b, "BEV_SUPPORTS_CALC"), default="BEV_SUPPORTS_DB")


def match_status(matched: Column, z: Column, db: Column) -> Column:
    return branches((~matched, "NEW_CALC"), (F.abs(z - db) <= 10, "MATCH_OK"), default="MATCH_ELEV")


def review_hint(status: Column, dist: Column, name_match: Column, support: Column) -> Column:
    return branches((status != "MATCH_ELEV", None), (support == "BEV_SUPPORTS_CALC", "LIKELY_DB_ELEV_ISSUE"), (support == "BEV_SUPPORTS_DB", "LIKELY_CALC_ELEV_ISSUE"), ((name_match == 0) | (dist > 150), "POSSIBLE_WRONG_SUMMIT_MATCH"), default="MANUAL_REVIEW")


def match_case_class(status: Column, position: Column, support: Column, hint: Column) -> Column:
    near = position.isin(*NEAR)
    return branches(
        (status != "MATCH_ELEV", status),
        (near & (support == "BEV_SUPPORTS_CALC"), "MATCH_ELEV_POS_OK_DB_HEIGHT_ISSUE"),
        (near & (support == "BEV_SUPPORTS_DB"), "MATCH_ELEV_POS_OK_CALC_HEIGHT_ISSUE"),
        (near & support.startswith("NO_BEV"), "MATCH_ELEV_POS_OK_NO_BEV"),
        (hint == "POSSIBLE_WRONG_SUMMIT_MATCH", "MATCH_ELEV_WRONG_SUMMIT_REVIEW"),
        (position == "RIDGE_OFFSET", "MATCH_ELEV_RIDGE_OFFSET"),
        (position == "REMOTE_OFFSET", "MATCH_ELEV_REMOTE_OFFSET"),
        default="MATCH_ELEV_MANUAL_REVIEW",
    )


def db_no_peak_reason(raw: Column, calc: Column, raw_keycol: Column) -> Column:
    return branches((raw.isNull() & calc.isNull(), "NO_RAW_PEAK_NO_CALC_IN_RADIUS"), (raw.isNull(), "NO_RAW_PEAK_NEAR_CALC"), (raw_keycol.isNull(), "RAW_PEAK_NO_KEYCOL"), default="RAW_PEAK_WITH_KEYCOL")


def ambiguity_score(dist: Column, zdiff: Column, keycol: Column, radius: float = 800, z_limit: float = 5, k_limit: float = 40) -> Column:
    part = lambda x, tight, wide: branches((x.isNull(), 0), (x <= tight, 2), (x <= wide, 1), default=0)
    return part(dist, min(250, 0.4 * radius), radius) + part(zdiff, 3, z_limit) + part(keycol, min(20, k_limit), k_limit)


def refined_match_elev(position: Column, support: Column, hint: Column, dist: Column, case: Column, link: float = 250) -> Column:
    near = position.isin(*NEAR)
    return branches(
        ((position == "EXACT_POS") & (support == "BEV_SUPPORTS_CALC"), "MATCH_ELEV_EXACT_POS_DB_ISSUE"),
        (near & (support == "BEV_SUPPORTS_CALC"), "MATCH_ELEV_NEAR_POS_DB_ISSUE"),
        (near & (support == "BEV_SUPPORTS_DB"), "MATCH_ELEV_POS_OK_CALC_HEIGHT_ISSUE"),
        ((hint == "POSSIBLE_WRONG_SUMMIT_MATCH") & (dist <= link), "MATCH_ELEV_NEAR_OFFICIAL_WRONG_SUMMIT"),
        (position.isin("RIDGE_OFFSET", "REMOTE_OFFSET"), "MATCH_ELEV_RIDGE_REVIEW"),
        default=F.coalesce(case, F.lit("MATCH_ELEV_MANUAL_REVIEW")),
    )


def refined_db_no_peak(partner: Column, zdiff: Column, same_keycol: Column, reciprocal: Column, raw_found: Column, z_limit: float = 5, soft: float = 10) -> Column:
    p = "DB_NO_PEAK_"
    return branches(
        (partner.isNotNull() & (zdiff <= z_limit) & (same_keycol == 1) & (reciprocal == 1), p + "SHARED_KEYCOL_STRICT"),
        (partner.isNotNull() & (zdiff <= soft) & (reciprocal == 1), p + "NEAR_CALC_REVIEW"),
        (partner.isNotNull() & (same_keycol == 1), p + "NEAR_CALC"),
        (partner.isNotNull(), p + "NEAR_CALC_NO_KEYCOL"),
        (raw_found == 1, p + "RAW_ONLY"),
        default=p + "NO_RAW_NO_CALC",
    )


def refined_new_calc(partner: Column, zdiff: Column, same_keycol: Column, reciprocal: Column, prom: Column, name_match: Column, review: Column, z_bev: Column, z_limit: float = 5, soft: float = 10) -> Column:
    p = "NEW_CALC_"
    return branches(
        (partner.isNotNull() & (zdiff <= z_limit) & (same_keycol == 1) & (reciprocal == 1), p + "SHARED_KEYCOL_PAIR"),
        (partner.isNotNull() & (zdiff <= soft) & (reciprocal == 1), p + "NEAR_DB_REVIEW"),
        ((prom >= 250) & (name_match == 1) & (review == 0), p + "STRONG"),
        ((prom >= 180) & (review == 1), p + "STRONG_BORDER"),
        ((name_match == 0) & z_bev.isNull(), p + "LOW_REFERENCE"),
        default=p + "MANUAL_REVIEW",
    )


def manual_review_required(refined: Column) -> Column:
    return F.when(refined.isin("MATCH_OK", "MATCH_ELEV_EXACT_POS_DB_ISSUE", "MATCH_ELEV_NEAR_POS_DB_ISSUE", "NEW_CALC_STRONG", "NEW_CALC_STRONG_BORDER"), 0).otherwise(1)


def severity(dz: Column, dist: Column) -> Column:
    at = lambda z, d: (dz >= z) & (dist >= d)
    return branches((dz.isNull() | dist.isNull(), "NO_DATA"), (at(25, 25), "SEVERE"), (at(10, 25), "STRONG"), (at(5, 20), "REVIEW"), (at(3, 10), "MINOR"), default="NONE")


def rank_of(sev: Column) -> Column:
    return F.array_position(F.lit(SEVERITIES), sev)


def issue_classes(off: Column, calc: Column, bev: Column, bev_code: Column, higher: Column, same_keycol: Column, names_differ: Column) -> Column:
    """`;`-joined tags of a row; off, calc and bev are severities."""
    grave = lambda s: s.isin("REVIEW", "STRONG", "SEVERE")
    calm = lambda s: s.isin("NONE", "MINOR")
    coord = grave(off) | grave(bev) | grave(calc)
    ident = F.coalesce(higher >= 3, F.lit(False))
    tags = F.array(
        F.when(grave(off), branches(((bev_code == 7302) & calm(bev), "DB_COORD_SHIFT_BEV_SUPPORT"), (calm(calc), "DB_COORD_SHIFT_CALC_SUPPORT"), default="OFFICIAL_POINT_NOT_ON_LOCAL_MAX")),
        F.when(grave(bev), F.lit("BEV_REFERENCE_POSITION_CONFLICT")),
        F.when(grave(calc), F.lit("CALC_POINT_NOT_ON_LOCAL_MAX")),
        F.when(ident, F.lit("CALC_HIGHER_THAN_OFFICIAL_NAMED_SUMMIT")),
        F.when((same_keycol == 1) & (coord | ident), F.lit("SHARED_KEYCOL_WITH_COORDINATE_CONFLICT")),
        F.when(names_differ & (coord | ident), F.lit("DB_NAME_OR_REFERENCE_CHECK")),
    )
    joined = F.array_join(F.array_distinct(F.array_compact(tags)), ";")
    return F.when(joined == "", "NO_COORDINATE_FLAG").otherwise(joined)


def auth_name(calc_code: Column, off_code: Column) -> Column:
    return branches((calc_code.isin(7302, 7303), F.concat(F.lit("BEV_CALC_"), calc_code.cast("string"))), (off_code.isin(7302, 7303), F.concat(F.lit("BEV_OFFICIAL_"), off_code.cast("string"))), ((calc_code == 7301) | (off_code == 7301), "BEV_CONTEXT_7301_ONLY"), default="NO_AUTHORITATIVE_BEV_NAME")


def row_score(dist: Column, has_name: Column, z_bev: Column, preference: Column, status: Column, name_match: Column, origin: Column, z: Column, exact: float = 15, near: float = 100) -> Column:
    flag = lambda cond, v: F.when(cond, v).otherwise(0.0)
    return (
        branches((dist <= exact, 5.0), (dist <= 50, 3.0), (dist <= near, 1.0), default=0.0)
        + flag(has_name == 1, 1.5)
        + flag(z_bev.isNotNull(), 2.0)
        + branches((preference == "OFFICIAL_SUMMIT_PREFERRED", 2.0), (preference == "CALC_POINT_SUPPORTED", 1.0), (preference == "DB_HEIGHT_SUPPORTED", 0.5), default=0.0)
        + flag(status == "DB_NO_PEAK", 1.0)
        + flag(name_match == 1, 0.5)
        + branches((origin == "CALC_PEAK", 1.0), (origin == "SOTA_DB", 0.75), default=0.0)
        + F.coalesce(z_bev / 1e5, F.lit(0.0))
        + F.coalesce(z / 1e6, F.lit(0.0))
    )


def _leaf(role, basis, conf, final, manual, replay, anchor):
    return F.struct(F.lit(role).alias("role"), (basis if isinstance(basis, Column) else F.lit(basis)).alias("basis"), F.lit(conf).alias("confidence"), F.lit(final).alias("final_flag"), F.lit(manual).alias("manual"), (replay if isinstance(replay, Column) else F.lit(replay)).cast("int").alias("replay"), anchor.alias("anchor"))


def singleton_decision(status: Column, refined: Column, position: Column, support: Column, hint: Column, has_dist: Column, anchor: Column) -> Column:
    """Struct role, basis, confidence, final_flag, manual, replay, anchor of a row outside any group."""
    keep = lambda other: F.coalesce(anchor, other if isinstance(other, Column) else F.lit(other))
    bev = F.lit("BEV_COORD")
    near = position.isin(*NEAR)
    far = F.coalesce(position.isin("RIDGE_OFFSET", "REMOTE_OFFSET"), F.lit(False))
    me, nc, db = status == "MATCH_ELEV", status == "NEW_CALC", status == "DB_NO_PEAK"
    fin, rev = "FINAL_SOTA_SUMMIT", "FINAL_SOTA_SUMMIT_REVIEW"
    return branches(
        (status == "MATCH_OK", _leaf(fin, "MATCH_OK_STABLE", "HIGH", 1, 0, 0, keep("MATCH_DB"))),
        (me & near & (refined.isin("MATCH_ELEV_EXACT_POS_DB_ISSUE", "MATCH_ELEV_NEAR_POS_DB_ISSUE") | (support == "BEV_SUPPORTS_CALC")), _leaf(fin, "DB_HEIGHT_CONFLICT_EXACT_OR_NEAR", "HIGH", 1, 0, 0, bev)),
        (me & near & ((support == "BEV_SUPPORTS_DB") | (refined == "MATCH_ELEV_POS_OK_CALC_HEIGHT_ISSUE")), _leaf(rev, "CALC_HEIGHT_CONFLICT_NEAR_OFFICIAL", "MEDIUM", 1, 1, 0, bev)),
        (me & near, _leaf(rev, "POS_OK_REFERENCE_POOR", "MEDIUM", 1, 1, 0, keep("SOTA_DB_ONLY"))),
        (me & (hint == "POSSIBLE_WRONG_SUMMIT_MATCH"), _leaf("REPLAY_REQUIRED", "RIDGE_OFFSET_WRONG_SUMMIT_REVIEW", "LOW", 0, 1, far, keep("BEV_COORD"))),
        (me, _leaf("REVIEW_REQUIRED", "RIDGE_OFFSET_MANUAL", "LOW", 0, 1, far, keep("BEV_COORD"))),
        (nc & (refined == "NEW_CALC_STRONG"), _leaf(fin, "CALC_STRONG_NO_CLOSE_DB", "HIGH", 1, 0, 0, keep("CALC_ONLY"))),
        (nc & (refined == "NEW_CALC_STRONG_BORDER"), _leaf(rev, "CALC_STRONG_BORDER", "MEDIUM", 1, 1, 0, keep("CALC_ONLY"))),
        (nc & refined.isin("NEW_CALC_NEAR_DB_REVIEW", "NEW_CALC_LOW_REFERENCE", "NEW_CALC_MANUAL_REVIEW"), _leaf("REVIEW_REQUIRED", refined, "LOW", 0, 1, refined == "NEW_CALC_NEAR_DB_REVIEW", keep(F.when(has_dist, "BEV_COORD").otherwise("CALC_ONLY")))),
        (nc, _leaf("REVIEW_REQUIRED", F.coalesce(refined, F.lit("NEW_CALC_REVIEW")), "LOW", 0, 1, 0, keep("CALC_ONLY"))),
        (db & (refined == "DB_NO_PEAK_RAW_ONLY"), _leaf("REVIEW_REQUIRED", "RAW_ONLY_NO_STABLE_PAIR", "LOW", 0, 1, 0, bev)),
        (db & refined.isin("DB_NO_PEAK_NEAR_CALC", "DB_NO_PEAK_NEAR_CALC_REVIEW"), _leaf("REVIEW_REQUIRED", refined, "LOW", 0, 1, 1, bev)),
        (db & (refined == "DB_NO_PEAK_NO_RAW_NO_CALC"), _leaf("UNRESOLVED_REFERENCE", "NO_RAW_NO_NEAR_CALC", "LOW", 0, 1, 1, bev)),
        (db, _leaf("REVIEW_REQUIRED", F.coalesce(refined, F.lit("DB_NO_PEAK_REVIEW")), "LOW", 0, 1, 0, bev)),
        (status == "FOREIGN_PEAK", _leaf("FOREIGN_CONTEXT", "FOREIGN_REFERENCE_ONLY", "HIGH", 0, 0, 0, keep("SOTA_DB_ONLY"))),
        default=_leaf("REVIEW_REQUIRED", "DEFAULT_REVIEW", "LOW", 0, 1, 0, anchor),
    )


def coordinate_gate(role: Column, flag: Column, manual: Column, replay: Column, basis: Column, conf: Column, tags: Column, sev: Column, ident: Column, review: Column) -> Column:
    """Struct role, final_flag, manual, replay, basis, confidence after the coordinate check."""
    hard_id = (ident == 1) | tags.contains("SHARED_KEYCOL_WITH_COORDINATE_CONFLICT") | tags.contains("CALC_HIGHER_THAN_OFFICIAL_NAMED_SUMMIT") | tags.contains("BEV_REFERENCE_POSITION_CONFLICT")
    hard_id, grave = F.coalesce(hard_id, F.lit(False)), F.coalesce(sev.isin("STRONG", "SEVERE"), F.lit(False))
    hard = hard_id | F.coalesce(sev == "SEVERE", F.lit(False))
    worse = F.when(grave | hard_id, "LOW").otherwise("MEDIUM")
    out = lambda r, f, m, p, b, c: F.struct(r.alias("role"), f.alias("final_flag"), m.alias("manual"), p.cast("int").alias("replay"), b.alias("basis"), c.alias("confidence"))
    one, req = F.lit(1), F.lit("COORDINATE_REVIEW_REQUIRED")
    same = out(role, flag, manual, replay, basis, conf)
    return branches(
        (~(F.coalesce(review == 1, F.lit(False)) & ~F.coalesce(tags, F.lit("")).isin("", "NO_COORDINATE_FLAG")) | ~hard, same),
        (role.isin("REVIEW_REQUIRED", "UNRESOLVED_REFERENCE", "REPLAY_REQUIRED", "FINAL_SOTA_SUMMIT_REVIEW"), out(role, flag, one, F.when((role == "UNRESOLVED_REFERENCE") & hard_id, 1).otherwise(replay), req, worse)),
        (role == "FINAL_SOTA_SUMMIT", out(F.lit("FINAL_SOTA_SUMMIT_REVIEW"), one, one, F.when(hard_id & grave, 1).otherwise(replay), F.when(hard_id, "COORDINATE_IDENTITY_REVIEW").otherwise(req), worse)),
        (role == "SECONDARY_SHARED_KEYCOL", out(F.lit("REVIEW_REQUIRED"), F.lit(0), one, F.when(hard_id | grave, 1).otherwise(replay), F.lit("PAIR_COORD_IDENTITY_REVIEW"), F.lit("LOW"))),
        default=out(role, flag, one, replay, req, F.lit("LOW")),
    )


def queue_class(replay: Column, name_queue: Column, manual: Column, final_flag: Column) -> Column:
    return branches((replay == 1, "REPLAY"), (name_queue == 1, "NAME_ENRICHMENT"), (manual == 1, "MANUAL_REVIEW"), (final_flag == 1, "FINAL_CONTEXT"), default="CONTEXT")


def refine_band(prom: Column) -> Column:
    return branches((prom >= 170, "SAFE"), (prom >= 130, "REFINE"), default="DROP")


def match_elev_links(position: Column, support: Column, hint: Column, dist: Column, link: float = 250) -> Column:
    """Struct preference, link, reason, ambiguous of a matched row of another height, in the order of refined_match_elev."""
    near = position.isin(*NEAR)
    wrong = (hint == "POSSIBLE_WRONG_SUMMIT_MATCH") & (dist <= link)
    calc, db = near & (support == "BEV_SUPPORTS_CALC"), near & (support == "BEV_SUPPORTS_DB")
    shadowed = F.coalesce(calc | db, F.lit(False))
    linked = F.coalesce(dist <= link, F.lit(False))
    is_wrong = F.coalesce(wrong, F.lit(False)) & ~shadowed
    return F.struct(
        branches((calc, "CALC_POINT_SUPPORTED"), (db, "DB_HEIGHT_SUPPORTED"), (wrong, "OFFICIAL_SUMMIT_REVIEW"), (position.isin("RIDGE_OFFSET", "REMOTE_OFFSET"), "MANUAL_REVIEW")).alias("preference"),
        linked.cast("int").alias("link"),
        branches((is_wrong, "MATCH_ELEV_WRONG_SUMMIT_REVIEW"), (linked, "MATCH_ELEV_OFFICIAL_LINK")).alias("reason"),
        is_wrong.cast("int").alias("ambiguous"),
    )


def pair_links(refined: Column, partner: Column, has_official: Column) -> Column:
    """Struct preference, link, reason, ambiguous, adopts of DB_NO_PEAK and NEW_CALC rows by their refined status."""
    found = partner.isNotNull()
    manual = (refined == "NEW_CALC_MANUAL_REVIEW") & found & has_official
    return F.struct(
        branches(
            (refined.isin("DB_NO_PEAK_SHARED_KEYCOL_STRICT", "NEW_CALC_SHARED_KEYCOL_PAIR"), "OFFICIAL_SUMMIT_PREFERRED"),
            (refined.isin("DB_NO_PEAK_NEAR_CALC_REVIEW", "NEW_CALC_NEAR_DB_REVIEW"), "OFFICIAL_SUMMIT_REVIEW"),
            (refined.isin("DB_NO_PEAK_NEAR_CALC", "DB_NO_PEAK_NEAR_CALC_NO_KEYCOL"), "MANUAL_REVIEW"),
        ).alias("preference"),
        ((refined.startswith("DB_NO_PEAK") & found) | refined.isin("NEW_CALC_SHARED_KEYCOL_PAIR", "NEW_CALC_NEAR_DB_REVIEW") | manual).cast("int").alias("link"),
        branches(
            (refined == "DB_NO_PEAK_SHARED_KEYCOL_STRICT", "DB_NO_PEAK_SHARED_KEYCOL"),
            (refined == "DB_NO_PEAK_NEAR_CALC_REVIEW", "DB_NO_PEAK_NEAR_CALC_REVIEW"),
            (refined.startswith("DB_NO_PEAK_NEAR_CALC"), "DB_NO_PEAK_NEAR_CALC"),
            (refined == "NEW_CALC_SHARED_KEYCOL_PAIR", "NEW_CALC_SHARED_KEYCOL"),
            (refined == "NEW_CALC_NEAR_DB_REVIEW", "NEW_CALC_NEAR_DB_REVIEW"),
            (manual, "NEW_CALC_MANUAL_REVIEW"),
        ).alias("reason"),
        refined.isin("DB_NO_PEAK_SHARED_KEYCOL_STRICT", "NEW_CALC_SHARED_KEYCOL_PAIR").cast("int").alias("ambiguous"),
        refined.isin("NEW_CALC_SHARED_KEYCOL_PAIR", "NEW_CALC_NEAR_DB_REVIEW").cast("int").alias("adopts"),
    )


def coordinate_result(off: Column, calc: Column, bev: Column, bev_code: Column, higher: Column, same_keycol: Column, names_differ: Column) -> Column:
    """Struct tags, severity (the gravest, without data REVIEW), coord, ident, names (review flags) and source of a row's point."""
    grave = lambda s: F.coalesce(s.isin("REVIEW", "STRONG", "SEVERE"), F.lit(False))
    calm = lambda s: s.isin("NONE", "MINOR")
    coord, top = grave(off) | grave(calc) | grave(bev), F.coalesce(higher >= 3, F.lit(False))
    tags = issue_classes(off, calc, bev, bev_code, higher, same_keycol, names_differ)
    worst = F.greatest(rank_of(off), rank_of(calc), rank_of(bev))
    source = F.when(grave(off), branches(((bev_code == 7302) & calm(bev), "BEV_NAME_7302_REVIEW"), (calm(calc), "CALC_PEAK_REVIEW"), default="MANUAL_REVIEW")).otherwise("UNCHANGED")
    grade = F.when(worst == 1, "REVIEW").otherwise(F.element_at(F.lit(SEVERITIES), worst.cast("int")))
    ident = top | ((same_keycol == 1) & (coord | top))
    return F.struct(
        tags.alias("tags"),
        F.when(tags == "NO_COORDINATE_FLAG", "NONE").otherwise(grade).alias("severity"),
        coord.cast("int").alias("coord"),
        ident.cast("int").alias("ident"),
        (names_differ & (coord | top)).cast("int").alias("names"),
        source.alias("source"),
    )


def name_evidence(calc_name: Column, calc_code: Column, off_name: Column, off_code: Column, db_name: Column, display: Column, origin: Column, open_check: Column) -> Column:
    """Struct name, source, support, fallback, queue, osm_allowed; names are cleaned texts, open_check: a review or replay is due."""
    strong = lambda n, c: F.coalesce(n.isNotNull() & c.isin(7302, 7303), F.lit(False))
    by_calc, by_off = strong(calc_name, calc_code), strong(off_name, off_code)
    source = branches((by_calc, F.concat(F.lit("BEV_CALC_"), calc_code.cast("string"))), (by_off, F.concat(F.lit("BEV_OFFICIAL_"), off_code.cast("string"))), default="NO_AUTHORITATIVE_BEV_NAME")
    none = ~(by_calc | by_off)
    fallback = none & (db_name.isNotNull() | display.isNotNull())
    n1 = F.concat(F.lit("N1_NO_AUTHORITATIVE_BEV_NAME"), F.when(fallback, "_SOTA_DB_FALLBACK").otherwise(""), F.when(open_check, "_WITH_GEO_OR_REPLAY").when(fallback, "").otherwise("_ONLY"))
    queue = branches((~F.coalesce(F.upper(origin) == "CALC_PEAK", F.lit(False)), "NOT_CALC_PEAK"), (~none, "BEV_AUTH_AVAILABLE"), default=n1)
    context = none & F.coalesce((calc_code == 7301) | (off_code == 7301), F.lit(False))
    return F.struct(
        branches((by_calc, calc_name), (by_off, off_name)).alias("name"),
        source.alias("source"),
        F.when(context, "BEV_CONTEXT_7301_ONLY").otherwise(source).alias("support"),
        fallback.cast("int").alias("fallback"),
        queue.alias("queue"),
        queue.startswith("N1_").cast("int").alias("osm_allowed"),
    )


def calc_name_support(name: Column, code: Column, z: Column, z_bev: Column) -> Column:
    """Struct available, support, z_diff of the name found at a calculated point."""
    ok = F.coalesce(name.isNotNull() & code.isin(7302, 7303), F.lit(False))
    return F.struct(ok.cast("int").alias("available"), F.when(ok, F.concat(F.lit("BEV_CALC_"), code.cast("string"))).otherwise("NO_BEV_AT_CALC_POINT").alias("support"), F.round(z - z_bev, 1).alias("z_diff"))


def group_decision(is_clear: Column, rank: Column, has_official: Column) -> Column:
    """Struct role, basis, confidence, final_flag, manual, replay of a group's member; rank: by score, the winner first."""
    leaf = lambda role, basis, conf, f, m, r: F.struct(F.lit(role).alias("role"), (basis if isinstance(basis, Column) else F.lit(basis)).alias("basis"), F.lit(conf).alias("confidence"), F.lit(f).alias("final_flag"), F.lit(m).alias("manual"), F.lit(r).alias("replay"))
    won = F.when(has_official, "OFFICIAL_PREFERRED_SHARED_KEYCOL").otherwise("BEV_HEIGHT_HIGHER_SHARED_KEYCOL")
    return branches(
        (~is_clear, leaf("REVIEW_REQUIRED", "SHARED_KEYCOL_REVIEW_REQUIRED", "LOW", 0, 1, 1)),
        (rank == 1, leaf("FINAL_SOTA_SUMMIT", won, "MEDIUM", 1, 0, 0)),
        default=leaf("SECONDARY_SHARED_KEYCOL", "PAIR_SECONDARY_TO_FINAL", "MEDIUM", 0, 0, 0),
    )


#: Association prefixes, the numbers and names of the areas they stand for.
PREFIXES = {
    "OE/VB-": (8, "Vorarlberg"),
    "OE/TI-": (7, "Tirol"),
    "OE/TL-": (7, "Tirol"),
    "OE/SB-": (5, "Salzburg"),
    "OE/KT-": (2, "Kärnten"),
    "OE/ST-": (6, "Steiermark"),
    "OE/OO-": (4, "Oberösterreich"),
    "OE/NO-": (3, "Niederösterreich"),
    "OE/BL-": (1, "Burgenland"),
    "OE/WI-": (9, "Wien"),
}


def prefix_land(code: Column) -> Column:
    """Struct land_id, land of a reference code; nulls for other prefixes."""
    key = F.substring(F.upper(F.trim(code)), 1, 6)
    ids, names = (F.create_map(*[F.lit(x) for k, v in PREFIXES.items() for x in (k, v[j])]) for j in (0, 1))
    return F.struct(F.try_element_at(ids, key).alias("land_id"), F.try_element_at(names, key).alias("land"))


def land_source(polygon: Column, land: Column, code: Column) -> Column:
    """Where a row's area comes from: its own field, the polygon it lies in, its code's prefix, or nowhere."""
    return branches((F.coalesce(land, F.lit("")) != "", "land"), (polygon.isNotNull(), "bl_join"), (prefix_land(code).getField("land").isNotNull(), "sota_ref"), default="missing")


def display_name(name: Column, db_name: Column, matched: Column) -> Column:
    """Struct name, source of the name shown for a row; a row without a match or name has none."""
    return F.struct(F.coalesce(name, F.when(matched, db_name)).alias("name"), branches((name.isNotNull(), "BEV_NAME"), (matched & db_name.isNotNull(), "SOTA_DB"), (matched, "UNKNOWN")).alias("source"))


def first_true(*columns: Column) -> Column:
    """The first number that is neither missing nor zero."""
    return F.coalesce(*[F.when(c != 0, c) for c in columns])
