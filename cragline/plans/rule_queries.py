"""Rule tables over the case view, each with independent SQL.

Fixed values: the labels and bounds in the SQL are those of the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from .views import view, with_sql

QUERIES: dict = {}
SQL: dict = {}
_C = F.col


def rule(name: str, columns, sql: str):
    QUERIES[name] = lambda spark, sf_dir: view(spark, sf_dir, "cases").select(_C("k"), *[c.alias(n) for n, c in columns().items()])
    SQL[name] = with_sql("cases") + f"SELECT k, {sql} FROM cases"


def fields(name: str, make, names: dict[str, str], sql: str):
    """A rule that gives a struct."""
    QUERIES[name] = lambda spark, sf_dir: view(spark, sf_dir, "cases").select("k", make().alias("s")).select("k", *[_C(f"s.{a}").alias(b) for a, b in names.items()])
    SQL[name] = with_sql("cases") + sql


NEAR = "('EXACT_POS','VERY_NEAR_POS','NEAR_POS')"
rule("position_class", lambda: {"label": R.position_class(_C("d"))}, "CASE WHEN d IS NULL THEN NULL WHEN d <= 15 THEN 'EXACT_POS' WHEN d <= 50 THEN 'VERY_NEAR_POS' WHEN d <= 100 THEN 'NEAR_POS' WHEN d <= 250 THEN 'RIDGE_OFFSET' ELSE 'REMOTE_OFFSET' END AS label")
rule("height_class", lambda: {"label": R.height_class(_C("dz"))}, "CASE WHEN dz IS NULL THEN NULL WHEN dz <= 10 THEN 'DB_HEIGHT_OK' WHEN dz <= 20 THEN 'DB_HEIGHT_MINOR_CONFLICT' ELSE 'DB_HEIGHT_MAJOR_CONFLICT' END AS label")
rule("border_zone", lambda: {"label": R.border_zone(_C("d") - 20)}, "CASE WHEN d IS NULL THEN NULL WHEN d > 70 THEN 'INNER' WHEN d >= 20 THEN 'BORDER_ZONE' ELSE 'OUTER' END AS label")
rule("admin_context", lambda: {"label": R.admin_context(_C("zone1"), _C("zone2")), "review": R.admin_review(R.admin_context(_C("zone1"), _C("zone2")))}, "label, CASE WHEN label = 'INNER' THEN 0 ELSE 1 END AS review FROM (SELECT k, CASE WHEN zone1 = 'BORDER_ZONE' AND zone2 = 'BORDER_ZONE' THEN 'AT_AND_BL_BORDER' WHEN zone1 = 'BORDER_ZONE' THEN 'AT_BORDER' WHEN zone2 = 'BORDER_ZONE' THEN 'BL_BORDER' ELSE 'INNER' END AS label FROM cases) AS cases_")
SQL["admin_context"] = SQL["admin_context"].removesuffix(" FROM cases")
rule("raw_peak_zone", lambda: {"label": R.raw_peak_zone(_C("far"))}, "CASE WHEN far IS NULL THEN 'NO_RAW_PEAK' WHEN far <= 100 THEN 'RAW_0_100' WHEN far <= 300 THEN 'RAW_100_300' WHEN far <= 600 THEN 'RAW_300_600' ELSE 'RAW_GT_600' END AS label")
rule("bev_support", lambda: {"label": R.bev_support(_C("z1"), _C("z2"), _C("z3"))}, "CASE WHEN z1 IS NULL OR z2 IS NULL OR z3 IS NULL THEN 'NO_BEV_AT_CALC_POINT' WHEN abs(abs(z2 - z1) - abs(z2 - z3)) <= 0.5 THEN 'BEV_EQUAL' WHEN abs(z2 - z1) < abs(z2 - z3) THEN 'BEV_SUPPORTS_CALC' ELSE 'BEV_SUPPORTS_DB' END AS label")
rule("match_status", lambda: {"label": R.match_status(_C("b1") == 1, _C("z1"), _C("z3"))}, "CASE WHEN b1 <> 1 THEN 'NEW_CALC' WHEN abs(z1 - z3) <= 10 THEN 'MATCH_OK' ELSE 'MATCH_ELEV' END AS label")
rule("review_hint", lambda: {"label": R.review_hint(_C("status"), _C("d"), _C("b2"), _C("support"))}, "CASE WHEN status <> 'MATCH_ELEV' THEN NULL WHEN support = 'BEV_SUPPORTS_CALC' THEN 'LIKELY_DB_ELEV_ISSUE' WHEN support = 'BEV_SUPPORTS_DB' THEN 'LIKELY_CALC_ELEV_ISSUE' WHEN b2 = 0 OR d > 150 THEN 'POSSIBLE_WRONG_SUMMIT_MATCH' ELSE 'MANUAL_REVIEW' END AS label")
rule("match_case_class", lambda: {"label": R.match_case_class(_C("status"), _C("pos"), _C("support"), _C("hint"))}, f"CASE WHEN status <> 'MATCH_ELEV' THEN status WHEN pos IN {NEAR} AND support = 'BEV_SUPPORTS_CALC' THEN 'MATCH_ELEV_POS_OK_DB_HEIGHT_ISSUE' WHEN pos IN {NEAR} AND support = 'BEV_SUPPORTS_DB' THEN 'MATCH_ELEV_POS_OK_CALC_HEIGHT_ISSUE' WHEN pos IN {NEAR} AND support LIKE 'NO\\_BEV%' ESCAPE '\\' THEN 'MATCH_ELEV_POS_OK_NO_BEV' WHEN hint = 'POSSIBLE_WRONG_SUMMIT_MATCH' THEN 'MATCH_ELEV_WRONG_SUMMIT_REVIEW' WHEN pos = 'RIDGE_OFFSET' THEN 'MATCH_ELEV_RIDGE_OFFSET' WHEN pos = 'REMOTE_OFFSET' THEN 'MATCH_ELEV_REMOTE_OFFSET' ELSE 'MATCH_ELEV_MANUAL_REVIEW' END AS label")
rule("db_no_peak_reason", lambda: {"label": R.db_no_peak_reason(_C("d"), _C("far"), _C("kd"))}, "CASE WHEN d IS NULL AND far IS NULL THEN 'NO_RAW_PEAK_NO_CALC_IN_RADIUS' WHEN d IS NULL THEN 'NO_RAW_PEAK_NEAR_CALC' WHEN kd IS NULL THEN 'RAW_PEAK_NO_KEYCOL' ELSE 'RAW_PEAK_WITH_KEYCOL' END AS label")
rule("ambiguity_score", lambda: {"score": R.ambiguity_score(_C("far"), _C("dz"), _C("kd"))}, "CASE WHEN far <= 250 THEN 2 WHEN far <= 800 THEN 1 ELSE 0 END + CASE WHEN dz <= 3 THEN 2 WHEN dz <= 5 THEN 1 ELSE 0 END + CASE WHEN kd <= 20 THEN 2 WHEN kd <= 40 THEN 1 ELSE 0 END AS score")
_me = f"CASE WHEN pos = 'EXACT_POS' AND support = 'BEV_SUPPORTS_CALC' THEN 'MATCH_ELEV_EXACT_POS_DB_ISSUE' WHEN pos IN {NEAR} AND support = 'BEV_SUPPORTS_CALC' THEN 'MATCH_ELEV_NEAR_POS_DB_ISSUE' WHEN pos IN {NEAR} AND support = 'BEV_SUPPORTS_DB' THEN 'MATCH_ELEV_POS_OK_CALC_HEIGHT_ISSUE' WHEN hint = 'POSSIBLE_WRONG_SUMMIT_MATCH' AND d <= 250 THEN 'MATCH_ELEV_NEAR_OFFICIAL_WRONG_SUMMIT' WHEN pos IN ('RIDGE_OFFSET','REMOTE_OFFSET') THEN 'MATCH_ELEV_RIDGE_REVIEW' ELSE coalesce(refined, 'MATCH_ELEV_MANUAL_REVIEW') END"
_rme = lambda: R.refined_match_elev(_C("pos"), _C("support"), _C("hint"), _C("d"), _C("refined"))
rule("refined_match_elev", lambda: {"label": _rme(), "manual": R.manual_review_required(_rme())}, f"{_me} AS label, CASE WHEN {_me} IN ('MATCH_OK','MATCH_ELEV_EXACT_POS_DB_ISSUE','MATCH_ELEV_NEAR_POS_DB_ISSUE','NEW_CALC_STRONG','NEW_CALC_STRONG_BORDER') THEN 0 ELSE 1 END AS manual")
rule("refined_db_no_peak", lambda: {"label": R.refined_db_no_peak(_C("d"), _C("dz"), _C("b1"), _C("b2"), _C("b3"))}, "'DB_NO_PEAK_' || CASE WHEN d IS NULL THEN CASE WHEN b3 = 1 THEN 'RAW_ONLY' ELSE 'NO_RAW_NO_CALC' END WHEN dz <= 5 AND b1 = 1 AND b2 = 1 THEN 'SHARED_KEYCOL_STRICT' WHEN dz <= 10 AND b2 = 1 THEN 'NEAR_CALC_REVIEW' WHEN b1 = 1 THEN 'NEAR_CALC' ELSE 'NEAR_CALC_NO_KEYCOL' END AS label")
rule("refined_new_calc", lambda: {"label": R.refined_new_calc(_C("d"), _C("dz"), _C("b1"), _C("b2"), _C("prom"), _C("b3"), _C("b4"), _C("z2"))}, "'NEW_CALC_' || CASE WHEN d IS NOT NULL AND dz <= 5 AND b1 = 1 AND b2 = 1 THEN 'SHARED_KEYCOL_PAIR' WHEN d IS NOT NULL AND dz <= 10 AND b2 = 1 THEN 'NEAR_DB_REVIEW' WHEN prom >= 250 AND b3 = 1 AND b4 = 0 THEN 'STRONG' WHEN prom >= 180 AND b4 = 1 THEN 'STRONG_BORDER' WHEN b3 = 0 AND z2 IS NULL THEN 'LOW_REFERENCE' ELSE 'MANUAL_REVIEW' END AS label")
rule("severity", lambda: {"label": R.severity(_C("dz"), _C("kd"))}, "CASE WHEN dz IS NULL OR kd IS NULL THEN 'NO_DATA' WHEN dz >= 25 AND kd >= 25 THEN 'SEVERE' WHEN dz >= 10 AND kd >= 25 THEN 'STRONG' WHEN dz >= 5 AND kd >= 20 THEN 'REVIEW' WHEN dz >= 3 AND kd >= 10 THEN 'MINOR' ELSE 'NONE' END AS label")
_G = "IN ('REVIEW','STRONG','SEVERE')"
rule(
    "issue_classes",
    lambda: {"tags": R.issue_classes(_C("sev1"), _C("sev2"), _C("sev3"), _C("code1"), _C("z3") - _C("z2"), _C("b1"), _C("b2") == 1)},
    f"""coalesce(nullif(concat_ws(';',
  CASE WHEN sev1 {_G} THEN CASE WHEN code1 = 7302 AND sev3 IN ('NONE','MINOR') THEN 'DB_COORD_SHIFT_BEV_SUPPORT' WHEN sev2 IN ('NONE','MINOR') THEN 'DB_COORD_SHIFT_CALC_SUPPORT' ELSE 'OFFICIAL_POINT_NOT_ON_LOCAL_MAX' END END,
  CASE WHEN sev3 {_G} THEN 'BEV_REFERENCE_POSITION_CONFLICT' END, CASE WHEN sev2 {_G} THEN 'CALC_POINT_NOT_ON_LOCAL_MAX' END,
  CASE WHEN z3 - z2 >= 3 THEN 'CALC_HIGHER_THAN_OFFICIAL_NAMED_SUMMIT' END,
  CASE WHEN b1 = 1 AND (sev1 {_G} OR sev2 {_G} OR sev3 {_G} OR coalesce(z3 - z2 >= 3, false)) THEN 'SHARED_KEYCOL_WITH_COORDINATE_CONFLICT' END,
  CASE WHEN b2 = 1 AND (sev1 {_G} OR sev2 {_G} OR sev3 {_G} OR coalesce(z3 - z2 >= 3, false)) THEN 'DB_NAME_OR_REFERENCE_CHECK' END), ''), 'NO_COORDINATE_FLAG') AS tags""",
)
rule("auth_name", lambda: {"label": R.auth_name(_C("code1"), _C("code2"))}, "CASE WHEN code1 IN (7302, 7303) THEN 'BEV_CALC_' || code1 WHEN code2 IN (7302, 7303) THEN 'BEV_OFFICIAL_' || code2 WHEN code1 = 7301 OR code2 = 7301 THEN 'BEV_CONTEXT_7301_ONLY' ELSE 'NO_AUTHORITATIVE_BEV_NAME' END AS label")
rule(
    "row_score",
    lambda: {"score": F.round(R.row_score(_C("d"), _C("b1"), _C("z2"), _C("pref"), _C("status"), _C("b2"), _C("origin"), _C("z1")), 6)},
    "round(CASE WHEN d <= 15 THEN 5.0 WHEN d <= 50 THEN 3.0 WHEN d <= 100 THEN 1.0 ELSE 0.0 END::DOUBLE + CASE WHEN b1 = 1 THEN 1.5 ELSE 0 END::DOUBLE + CASE WHEN z2 IS NOT NULL THEN 2 ELSE 0 END + CASE pref WHEN 'OFFICIAL_SUMMIT_PREFERRED' THEN 2.0 WHEN 'CALC_POINT_SUPPORTED' THEN 1.0 WHEN 'DB_HEIGHT_SUPPORTED' THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN status = 'DB_NO_PEAK' THEN 1 ELSE 0 END + CASE WHEN b2 = 1 THEN 0.5 ELSE 0 END::DOUBLE + CASE origin WHEN 'CALC_PEAK' THEN 1.0 WHEN 'SOTA_DB' THEN 0.75 ELSE 0 END::DOUBLE + coalesce(z2 / 1e5, 0) + coalesce(z1 / 1e6, 0), 6) AS score",
)
_ROW = "{{'role': '{}', 'basis': {}, 'confidence': '{}', 'f': {}, 'm': {}, 'r': {}, 'a': {}}}"
_row = lambda role, basis, conf, f, m, r, a: _ROW.format(role, basis if "refined" in basis else f"'{basis}'", conf, f, m, r, a)
_FAR = "CASE WHEN pos IN ('RIDGE_OFFSET','REMOTE_OFFSET') THEN 1 ELSE 0 END"
fields(
    "singleton_decision",
    lambda: R.singleton_decision(_C("status"), _C("refined"), _C("pos"), _C("support"), _C("hint"), _C("d").isNotNull(), _C("anchor")),
    {"role": "role", "basis": "basis", "confidence": "confidence", "final_flag": "final_flag", "manual": "manual", "replay": "replay", "anchor": "anchor"},
    f"""SELECT k, s.role AS role, s.basis AS basis, s.confidence AS confidence, s.f AS final_flag, s.m AS manual, s.r AS replay, s.a AS anchor FROM (SELECT k, CASE
 WHEN status = 'MATCH_OK' THEN {_row("FINAL_SOTA_SUMMIT", "MATCH_OK_STABLE", "HIGH", 1, 0, 0, "coalesce(anchor, 'MATCH_DB')")}
 WHEN status = 'MATCH_ELEV' THEN CASE
  WHEN pos IN {NEAR} THEN CASE
   WHEN refined IN ('MATCH_ELEV_EXACT_POS_DB_ISSUE','MATCH_ELEV_NEAR_POS_DB_ISSUE') OR support = 'BEV_SUPPORTS_CALC' THEN {_row("FINAL_SOTA_SUMMIT", "DB_HEIGHT_CONFLICT_EXACT_OR_NEAR", "HIGH", 1, 0, 0, "'BEV_COORD'")}
   WHEN support = 'BEV_SUPPORTS_DB' OR refined = 'MATCH_ELEV_POS_OK_CALC_HEIGHT_ISSUE' THEN {_row("FINAL_SOTA_SUMMIT_REVIEW", "CALC_HEIGHT_CONFLICT_NEAR_OFFICIAL", "MEDIUM", 1, 1, 0, "'BEV_COORD'")}
   ELSE {_row("FINAL_SOTA_SUMMIT_REVIEW", "POS_OK_REFERENCE_POOR", "MEDIUM", 1, 1, 0, "coalesce(anchor, 'SOTA_DB_ONLY')")} END
  WHEN hint = 'POSSIBLE_WRONG_SUMMIT_MATCH' THEN {_row("REPLAY_REQUIRED", "RIDGE_OFFSET_WRONG_SUMMIT_REVIEW", "LOW", 0, 1, _FAR, "coalesce(anchor, 'BEV_COORD')")}
  ELSE {_row("REVIEW_REQUIRED", "RIDGE_OFFSET_MANUAL", "LOW", 0, 1, _FAR, "coalesce(anchor, 'BEV_COORD')")} END
 WHEN status = 'NEW_CALC' THEN CASE
  WHEN refined = 'NEW_CALC_STRONG' THEN {_row("FINAL_SOTA_SUMMIT", "CALC_STRONG_NO_CLOSE_DB", "HIGH", 1, 0, 0, "coalesce(anchor, 'CALC_ONLY')")}
  WHEN refined = 'NEW_CALC_STRONG_BORDER' THEN {_row("FINAL_SOTA_SUMMIT_REVIEW", "CALC_STRONG_BORDER", "MEDIUM", 1, 1, 0, "coalesce(anchor, 'CALC_ONLY')")}
  WHEN refined IN ('NEW_CALC_NEAR_DB_REVIEW','NEW_CALC_LOW_REFERENCE','NEW_CALC_MANUAL_REVIEW') THEN {_row("REVIEW_REQUIRED", "refined", "LOW", 0, 1, "CASE WHEN refined = 'NEW_CALC_NEAR_DB_REVIEW' THEN 1 ELSE 0 END", "coalesce(anchor, CASE WHEN d IS NOT NULL THEN 'BEV_COORD' ELSE 'CALC_ONLY' END)")}
  ELSE {_row("REVIEW_REQUIRED", "coalesce(refined, 'NEW_CALC_REVIEW')", "LOW", 0, 1, 0, "coalesce(anchor, 'CALC_ONLY')")} END
 WHEN status = 'DB_NO_PEAK' THEN CASE
  WHEN refined = 'DB_NO_PEAK_RAW_ONLY' THEN {_row("REVIEW_REQUIRED", "RAW_ONLY_NO_STABLE_PAIR", "LOW", 0, 1, 0, "'BEV_COORD'")}
  WHEN refined IN ('DB_NO_PEAK_NEAR_CALC','DB_NO_PEAK_NEAR_CALC_REVIEW') THEN {_row("REVIEW_REQUIRED", "refined", "LOW", 0, 1, 1, "'BEV_COORD'")}
  WHEN refined = 'DB_NO_PEAK_NO_RAW_NO_CALC' THEN {_row("UNRESOLVED_REFERENCE", "NO_RAW_NO_NEAR_CALC", "LOW", 0, 1, 1, "'BEV_COORD'")}
  ELSE {_row("REVIEW_REQUIRED", "coalesce(refined, 'DB_NO_PEAK_REVIEW')", "LOW", 0, 1, 0, "'BEV_COORD'")} END
 WHEN status = 'FOREIGN_PEAK' THEN {_row("FOREIGN_CONTEXT", "FOREIGN_REFERENCE_ONLY", "HIGH", 0, 0, 0, "coalesce(anchor, 'SOTA_DB_ONLY')")}
 ELSE {_row("REVIEW_REQUIRED", "DEFAULT_REVIEW", "LOW", 0, 1, 0, "anchor")} END AS s FROM cases)""",
)
fields(
    "coordinate_gate",
    lambda: R.coordinate_gate(_C("role"), _C("b2"), _C("b3"), _C("b4"), F.lit("KEEP"), F.lit("HIGH"), _C("tags"), _C("sev1"), _C("b1"), F.when(_C("prom") % 3 > 0, 1).otherwise(0)),
    {"role": "role_", "final_flag": "final_flag", "manual": "manual", "replay": "replay", "basis": "basis", "confidence": "confidence"},
    """, g AS (SELECT *, b1 = 1 OR coalesce(contains(tags, 'BEV_REFERENCE_POSITION_CONFLICT'), false) AS hid, sev1 IN ('STRONG','SEVERE') AS grave, prom % 3 > 0 AND coalesce(tags, 'NO_COORDINATE_FLAG') <> 'NO_COORDINATE_FLAG' AS active FROM cases),
h AS (SELECT *, active AND (hid OR sev1 = 'SEVERE') AS hard FROM g)
SELECT k,
 CASE WHEN hard AND role = 'FINAL_SOTA_SUMMIT' THEN 'FINAL_SOTA_SUMMIT_REVIEW' WHEN hard AND role = 'SECONDARY_SHARED_KEYCOL' THEN 'REVIEW_REQUIRED' ELSE role END AS role_,
 CASE WHEN hard AND role = 'FINAL_SOTA_SUMMIT' THEN 1 WHEN hard AND role = 'SECONDARY_SHARED_KEYCOL' THEN 0 ELSE b2 END AS final_flag,
 CASE WHEN hard THEN 1 ELSE b3 END AS manual,
 CASE WHEN hard AND role = 'UNRESOLVED_REFERENCE' AND hid THEN 1 WHEN hard AND role = 'FINAL_SOTA_SUMMIT' AND hid AND grave THEN 1 WHEN hard AND role = 'SECONDARY_SHARED_KEYCOL' AND (hid OR grave) THEN 1 ELSE b4 END AS replay,
 CASE WHEN NOT hard THEN 'KEEP' WHEN role = 'FINAL_SOTA_SUMMIT' AND hid THEN 'COORDINATE_IDENTITY_REVIEW' WHEN role = 'SECONDARY_SHARED_KEYCOL' THEN 'PAIR_COORD_IDENTITY_REVIEW' ELSE 'COORDINATE_REVIEW_REQUIRED' END AS basis,
 CASE WHEN NOT hard THEN 'HIGH' WHEN role IN ('REVIEW_REQUIRED','UNRESOLVED_REFERENCE','REPLAY_REQUIRED','FINAL_SOTA_SUMMIT_REVIEW','FINAL_SOTA_SUMMIT') AND NOT (hid OR grave) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM h""",
)
rule("queue_class", lambda: {"label": R.queue_class(_C("b1"), _C("b2"), _C("b3"), _C("b4"))}, "CASE WHEN b1 = 1 THEN 'REPLAY' WHEN b2 = 1 THEN 'NAME_ENRICHMENT' WHEN b3 = 1 THEN 'MANUAL_REVIEW' WHEN b4 = 1 THEN 'FINAL_CONTEXT' ELSE 'CONTEXT' END AS label")
rule("refine_band", lambda: {"label": R.refine_band(_C("prom"))}, "CASE WHEN prom >= 170 THEN 'SAFE' WHEN prom >= 130 THEN 'REFINE' ELSE 'DROP' END AS label")
