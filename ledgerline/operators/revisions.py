"""Repositories and their revisions: addresses, shapes, routing of files, holds and comparisons."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.ids import as_col
from ledgerline.functions.namespaces import tree_path_valid
from ledgerline.operators.parsers import _table

#: Where revisions are served, and the grammar of slugs, branches and commits. Fixed values.
API, RAW, MIRROR = "https://api.github.com/repos", "https://raw.githubusercontent.com", "https://cdn.jsdelivr.net/gh"
SLUG = r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?/[A-Za-z0-9._-]{1,100}$"
BRANCH = r"^[A-Za-z0-9._/-]{1,100}$"
COMMIT = "^[0-9a-fA-F]{40}$"
PATCH = r"^https://github\.com/([^/]+/[^/]+)/commit/([0-9a-fA-F]{40})\.patch$"
#: Codes that alone don't hold material back. Fixed values.
NOT_MATERIAL = [
    "CONFIDENTIAL_MARKER_CANDIDATE", "HIDDEN_DOM_PRESENT", "LOGIN_FORM_INDICATOR", "RUNTIME_ENDPOINT_UNRESOLVED", "RUNTIME_ENDPOINT_CANDIDATE", "KR_BUSINESS_NUMBER_CANDIDATE",
    "STRUCTURED_DATA_PARSE_INCOMPLETE", "JSON_PARSE_INCOMPLETE", "HTML_PARSE_INCOMPLETE",
]
IMAGES = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff"]
BINARIES = ["zip", "gz", "7z", "rar", "tar", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "hwp", "exe", "dll", "so", "woff", "woff2", "ttf", "mp3", "mp4"]
TEXT_TYPES = {"json": "application/json", "html": "text/html", "htm": "text/html", "js": "application/javascript", "mjs": "application/javascript", "css": "text/css", "csv": "text/csv", "xml": "application/xml"}


def quoted(text: str | Column, slashes: bool = False) -> Column:
    """Percent-encoding of all but letters, digits and `-._~`, and of slashes unless they stay."""
    out = F.replace(F.replace(F.replace(F.url_encode(as_col(text)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%2F"), F.lit("/")) if slashes else out


def revision_kind(value: str | Column) -> Column:
    """commit, branch_mutable, or null for what is neither."""
    v = as_col(value)
    branch = v.rlike(BRANCH) & ~v.rlike(r"\.\.|^/|/$|//")
    return F.when(v.rlike(COMMIT), "commit").when(branch, "branch_mutable")


def tree_url(slug: str | Column, revision: str | Column) -> Column:
    sound = as_col(slug).rlike(SLUG) & revision_kind(revision).isNotNull()
    return F.when(sound, F.concat(F.lit(API + "/"), as_col(slug), F.lit("/git/trees/"), quoted(revision), F.lit("?recursive=1")))


def history_url(slug: str | Column, revision: str | Column) -> Column:
    sound = as_col(slug).rlike(SLUG) & revision_kind(revision).isNotNull()
    return F.when(sound, F.concat(F.lit(API + "/"), as_col(slug), F.lit("/commits?sha="), quoted(revision), F.lit("&per_page=5")))


def commit_detail_url(patch_url: str | Column, per_page: int = 100) -> Column:
    slug, sha = (F.regexp_extract(as_col(patch_url), PATCH, n) for n in (1, 2))
    return F.when((sha != "") & slug.rlike(SLUG), F.concat(F.lit(API + "/"), slug, F.lit("/commits/"), F.lower(sha), F.lit(f"?per_page={per_page}&page=1")))


def raw_url(slug: str | Column, sha: str | Column, path: str | Column) -> Column:
    sound = as_col(slug).rlike(SLUG) & as_col(sha).rlike(COMMIT) & tree_path_valid(path)
    return F.when(sound, F.concat(F.lit(RAW + "/"), as_col(slug), F.lit("/"), as_col(sha), F.lit("/"), quoted(path, True)))


def shaped(repositories: DataFrame) -> DataFrame:
    """Candidate of each repository (slug, revision): its pages, its mirror and what its revision is; unsound slugs are left out."""
    owner, name = F.split_part("slug", F.lit("/"), F.lit(1)), F.split_part("slug", F.lit("/"), F.lit(2))
    home = F.concat(F.lower(owner), F.lit(".github.io"))
    pages = F.concat(F.lit("https://"), home, F.lit("/"), F.when(F.lower(name) == home, "").otherwise(F.concat(quoted(name), F.lit("/"))))
    kind = revision_kind("revision")
    mirror = F.when(kind.isNotNull(), F.concat(F.lit(MIRROR + "/"), "slug", F.lit("@"), quoted("revision", True), F.lit("/")))
    return repositories.where(F.col("slug").rlike(SLUG)).select("slug", pages.alias("pages_url"), mirror.alias("mirror_url"), kind.alias("revision_kind"))


def material_hold(codes: str | Column) -> Column:
    """Whether signals hold material back: any code that proves something, or none at all (nothing was told)."""
    return (F.size(F.array_except(as_col(codes), F.array(*map(F.lit, NOT_MATERIAL)))) > 0) | (F.size(as_col(codes)) == 0)


def file_route(path: str | Column, head: str | Column) -> Column:
    """How a file is reviewed, by its suffix and its first bytes (binary): image, unsupported_binary, svg or text."""
    suffix, b = F.lower(F.regexp_extract(as_col(path), r"[^/]\.([A-Za-z0-9]+)$", 1)), F.hex(F.substring(as_col(head), 1, 4096))
    magic = lambda *h: b.rlike("^(?:" + "|".join(h) + ")")
    image = suffix.isin(IMAGES) | magic("89504E470D0A1A0A", "474946383[79]61", "FFD8FF", "52494646.{8}57454250")
    binary = suffix.isin(BINARIES) | magic("504B0304", "25504446", "1F8B", "D0CF11E0", "7F454C46", "4D5A") | b.rlike("^(?:..)*?00")
    svg = (suffix == "svg") | F.try_validate_utf8(F.substring(as_col(head), 1, 4096).cast("string")).rlike(r"^\s*(?:<svg|<\?xml(?s:.*)<svg)")
    return F.when(image, "image").when(binary, "unsupported_binary").when(F.coalesce(svg, F.lit(False)), "svg").otherwise("text")


def inferred_type(path: str | Column, declared: str | Column) -> Column:
    """Content type of a file by its suffix, else as declared, else application/octet-stream."""
    suffix = F.lower(F.regexp_extract(as_col(path), r"[^/]\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for s, kind in TEXT_TYPES.items():
        out = F.when(suffix == s, F.lit(kind)).otherwise(out)
    return F.coalesce(out, as_col(declared), F.lit("application/octet-stream"))


def mirror_states(captures: DataFrame, keys: list[str]) -> DataFrame:
    """Per place (keys) whether all its captures are the same: same_at_observation, different_at_observation or comparison_pending.

    captures: keys, representation, sha256, capture_complete. Only complete captures of one representation compare. No
    pairs are made: all are equal if the least and the greatest digest are.
    """
    sound = F.col("capture_complete") & F.col("sha256").rlike("^[0-9a-f]{64}$") & F.col("representation").isNotNull()
    g = captures.groupBy(*keys).agg(F.count(F.lit(1)).alias("captures"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound"), F.min("representation").alias("r0"), F.max("representation").alias("r1"), F.min("sha256").alias("s0"), F.max("sha256").alias("s1"))
    state = F.when(~F.col("sound") | (F.col("r0") != F.col("r1")), "comparison_pending").when(F.col("s0") == F.col("s1"), "same_at_observation").otherwise("different_at_observation")
    return g.where("captures > 1").select(*keys, "captures", state.alias("state"))


def lineage_hold(rows: DataFrame, lineage: str, held: Column) -> DataFrame:
    """Rows that are held because some row of their lineage is; rows without a lineage are held by themselves only."""
    any_held = rows.where(held & F.col(lineage).isNotNull()).select(F.col(lineage).alias("_l")).distinct()
    out = rows.withColumn("_self", F.coalesce(held, F.lit(False))).join(any_held, F.col(lineage) == F.col("_l"), "left")
    return out.withColumn("held", F.col("_self") | F.col("_l").isNotNull()).drop("_self", "_l")


#: Grammars and words of interaction steps. Fixed values.
_STEP_ID, _STEP_CLASS, _STEP_VALUE = (re.compile(p) for p in (r"[A-Za-z][A-Za-z0-9_:.-]{0,99}\Z", r"[A-Za-z_][A-Za-z0-9_-]{0,99}\Z", r"TEST_[A-Za-z0-9_-]{1,32}\Z"))
_STEP_NEVER = re.compile("login|log-in|signin|sign-in|password|passwd|credential|auth|submit", re.I)
_STEP_MORE = {"expect_visible_ids", "expect_hidden_ids", "expect_png_download", "expect_dom_change"}
#: Needed and optional fields of each action, beside the expectations. Fixed values.
_STEPS = {"click": (set(), {"target_id", "target_button_class", "target_index"}), "select": ({"target_id", "index"}, set()), "check": ({"target_id", "checked"}, set()), "fill": ({"target_id", "value"}, set()), "wait": ({"milliseconds"}, set())}


def _ids(value, most: int) -> bool:
    return isinstance(value, list) and len(value) <= most and all(isinstance(x, str) and _STEP_ID.match(x) for x in value) and len(set(value)) == len(value)


def _whole(value, low: int, high: int) -> bool:
    return type(value) is int and low <= value <= high


def step_problem(step) -> str | None:
    """Why an interaction step is not allowed, or None."""
    if not isinstance(step, dict) or step.get("action") not in _STEPS:
        return "invalid_ui_steps"
    action = step["action"]
    needed, more = _STEPS[action]
    names = set(step) - {"action"}
    if not needed <= names or not names <= needed | more | _STEP_MORE:
        return "invalid_ui_steps"
    by_class = "target_button_class" in step
    shown, gone = step.get("expect_visible_ids", []), step.get("expect_hidden_ids", [])
    sound = _ids(shown, 4) and _ids(gone, 4) and not set(shown) & set(gone) and all(isinstance(step.get(k, False), bool) for k in ("expect_png_download", "expect_dom_change"))
    if action == "click":
        sound = sound and ("target_id" in step) != by_class and ("target_index" not in step or by_class and _whole(step["target_index"], 0, 63))
    if action == "wait":
        return None if sound and _whole(step["milliseconds"], 1, 2000) else "invalid_ui_steps"
    target = step.get("target_button_class" if by_class else "target_id")
    if not sound or not isinstance(target, str) or not (_STEP_CLASS if by_class else _STEP_ID).match(target):
        return "invalid_ui_steps"
    if _STEP_NEVER.search(target):
        return "prohibited_ui_target"
    if action == "select" and not _whole(step["index"], 0, 100) or action == "check" and not isinstance(step["checked"], bool):
        return "invalid_ui_steps"
    if action == "fill" and not (isinstance(step["value"], str) and _STEP_VALUE.match(step["value"])):
        return "prohibited_ui_value"
    return None


def interaction_steps(plans: DataFrame) -> DataFrame:
    """Whether declared interactions (id, body: JSON with ui_steps) may run: id, reason (null if so), steps.

    At most 12 steps and 16 observed targets. A body that is no JSON object is invalid_ui_steps; null bodies give no row.
    """

    def one(id_, body) -> Iterator[tuple]:
        try:
            plan = json.loads(body)
        except (ValueError, RecursionError):
            plan = None
        if not isinstance(plan, dict):
            yield id_, "invalid_ui_steps", 0
            return
        steps, png = plan.get("ui_steps", []), plan.get("observe_png_download", False)
        if not _ids(plan.get("observe_target_ids", []), 16):
            reason = "invalid_observe_target_ids"
        elif not isinstance(steps, list) or len(steps) > 12:
            reason = "invalid_ui_steps"
        else:
            reason = next((p for p in map(step_problem, steps) if p), None)
            if reason is None and not isinstance(png, bool):
                reason = "invalid_png_observation"
            if reason is None and not png and any(s.get("expect_png_download") for s in steps):
                reason = "png_observation_not_authorized"
        yield id_, reason, 0 if reason else len(steps)

    return _table(plans.where("body is not null"), ["id", "body"], "id bigint, reason string, steps bigint", one)
