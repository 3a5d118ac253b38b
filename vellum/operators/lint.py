"""Rules over notes, files and settings: what is pinned, in scope, contradicted, complete, old or missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import dates
from vellum.functions import text as T

# Files that no mode moves, by name and by prefix.
PINNED = "_session_handoff.md _index.md _index_errors.log _auto_writes.md _cleanup_log.md _retrofit_log.md _build_index.py _lint_frontmatter.py _retrofit_frontmatter.py _run_retrieval_eval.py".split()
PINNED_PREFIXES = "_guide_ _eval_ _index_ _audit_ _cleanup_proposal_ _log_rotation_proposal_ _upgrade_audit_ _upgrade_proposal_ _approval_packet_ _automation_setup_ _cleanup_dryrun_ _revert_log_ _synthesis_ _session_handoff_archive".split()
# Types that a contradiction is sought among.
POOL_TYPES = ("source", "decision")
# Checks of the three temporal bases, as (base, check, fields, whether the filters count, whether the orders count).
BASE_CHECKS = (
    ("Latest Only", "BC-01a", "is_latest_version", True, False),
    ("Latest Only", "BC-01b", "document_date", False, True),
    ("As Of", "BC-02(a)", "document_date", True, False),
    ("As Of", "BC-02(b)", "superseded_date", True, False),
    ("Version Chain", "BC-03a", "document_version", True, True),
    ("Version Chain", "BC-03b", "file.name", False, True),
)
# What a project's guide must mention, as (fault, any of these); and folders and files that may hold its log, handoff and guide.
GUIDE_MARKERS = (
    ("identity", ("## Who", "## Identity", "**Project:**")),
    ("bootstrap", ("Session Bootstrap", "session-bootstrap", "session start")),
    ("write_rule", ("Write Rule", "99 Workspace/", "cowork_outputs/", "auto-write")),
)
FOREIGN_MARKERS = ("M9", "multilingual", "PT/ES", "non-English")
WRITE_ZONES = ("99 Workspace", "cowork_outputs")
GUIDES = ("90 System/_operating_guide.md", "cowork_outputs/_guide_context_engineering.md")
# Defaults by zone, as (zones, claim_type, confidence).
EPISTEMICS = (
    (("60 Concepts",), "inference", 0.7),
    (("10 People", "20 Companies", "40 Meetings", "50 Sources", "70 Decisions"), "evidence", 0.7),
    (("30 Projects",), None, 0.7),
    (("00 Inbox",), None, 0.2),
)


def pinned(name: Column, state_file: Column | None = None) -> Column:
    found = reduce(Column.__or__, [F.startswith(name, F.lit(p)) for p in PINNED_PREFIXES], name.isin(PINNED))
    return found if state_file is None else found | F.coalesce(name == state_file, F.lit(False))


def confidential(name: Column) -> Column:
    """File names of the form ``*.confidential.*``."""
    return name.rlike(r"\.confidential\.")


def in_scope(reply: Column) -> tuple[Column, Column]:
    """Whether a classifier's reply leaves a file in scope, and why; without a reply or with one that cannot be read it does."""
    found = F.from_json(T.first_json(F.coalesce(reply, F.lit(""))), "in_scope boolean, reason string")
    unread = (T.first_json(F.coalesce(reply, F.lit(""))) == "") | F.try_parse_json(T.first_json(F.coalesce(reply, F.lit("")))).isNull()
    reason = F.when(reply.isNull(), "no_classifier").when(unread, "classifier_parse_error").otherwise(F.coalesce(found["reason"], F.lit("")))
    return reply.isNull() | unread | F.coalesce(found["in_scope"], F.lit(True)), reason


def contradiction_pool(notes: DataFrame) -> DataFrame:
    """Notes of the two types that no field marks as superseded."""
    plain = F.regexp_replace(F.trim(F.coalesce("type", F.lit(""))), "^[\"']+|[\"']+$", "")
    latest = F.lower(F.trim(F.coalesce(F.col("is_latest_version").cast("string"), F.lit(""))))
    return notes.where(plain.isin(*POOL_TYPES) & ~latest.isin("false", "no", "0"))


def contradiction_status(reply: Column, least: float = 0.7) -> Column:
    """PENDING without a reply, ERROR for one without the three keys, FLAGGED at ``least`` confidence, else NOT_CONTRADICTION."""
    raw = T.unfenced(reply)
    value = F.try_parse_json(raw)
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    whole = reduce(Column.__and__, [F.array_contains(keys, k) for k in ("contradiction", "confidence", "evidence")])
    true = F.schema_of_variant(F.try_variant_get(value, "$.contradiction", "variant")) == "BOOLEAN"
    sure = F.coalesce(F.try_variant_get(value, "$.confidence", "double"), F.lit(0.0)) >= least
    flagged = true & F.coalesce(F.try_variant_get(value, "$.contradiction", "boolean"), F.lit(False)) & sure
    return F.when(reply.isNull(), "PENDING").when(value.isNull() | ~whole, "ERROR").when(F.coalesce(flagged, F.lit(False)), "FLAGGED").otherwise("NOT_CONTRADICTION")


def filter_fields(filters: Column) -> Column:
    """Fields that the clauses of a filter's text name."""
    return F.array_distinct(F.regexp_extract_all(filters, F.lit(r"([A-Za-z_][\w.]*)\s*(?:==|!=|<=|>=|<|>)"), F.lit(1)))


def base_checks(specs: DataFrame) -> DataFrame:
    """(base, check_id, passed) of the temporal bases among ``specs`` (base, filter_fields, order_fields)."""
    table = F.array(*[F.struct(F.lit(b).alias("of"), F.lit(c).alias("check_id"), F.lit(f).alias("field"), F.lit(x).alias("filters"), F.lit(y).alias("orders")) for b, c, f, x, y in BASE_CHECKS])
    rows = specs.withColumn("c", F.explode(F.filter(table, lambda c: c["of"] == F.col("base"))))
    passed = (F.col("c.filters") & F.array_contains("filter_fields", F.col("c.field"))) | (F.col("c.orders") & F.array_contains("order_fields", F.col("c.field")))
    return rows.select(*specs.columns, "c.check_id", passed.alias("passed"))


def base_counts(notes: DataFrame, bases: dict[str, str]) -> DataFrame:
    """(base, n_pass, n_fail) for every base: its notes without and with violations. ``notes``: type, n_violations; ``bases``: base by type."""
    rows = notes.groupBy("type").agg(F.count_if(F.col("n_violations") == 0).alias("n_pass"), F.count_if(F.col("n_violations") > 0).alias("n_fail"))
    known = notes.sparkSession.createDataFrame([(t, b) for t, b in bases.items()], "type string, base string")
    return known.join(rows, "type", "left").select("base", F.coalesce("n_pass", F.lit(0)).alias("n_pass"), F.coalesce("n_fail", F.lit(0)).alias("n_fail"))


def without_base(notes: DataFrame, vocabulary: list[str], bases: dict[str, str], unbound: list[str]) -> DataFrame:
    """Notes of a known type that no base shows and that is not free of one. A type on both lists is an error."""
    if both := sorted(set(bases) & set(unbound)):
        raise ValueError(f"types with a base are listed as free of one: {both}")
    return notes.where(F.col("type").isin(vocabulary) & ~F.col("type").isin([*bases, *unbound]))


def signals(notes: DataFrame, group: str, line: str, cap: int = 20) -> DataFrame:
    """(group, n, lines, n_more): the first ``cap`` lines of each group in order and how many there are beyond. Groups of any size: a task keeps its own first ones."""
    counts = notes.groupBy(group).agg(F.count("*").alias("n"))
    first = notes.select(group, line).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(line))).where(F.col("place") <= cap)
    listed = first.groupBy(group).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return counts.join(listed, group).select(group, "n", "lines", F.greatest(F.col("n") - cap, F.lit(0)).alias("n_more"))


def glob(name: Column, pattern: str) -> Column:
    """Whether a name matches a shell pattern of ``*`` and ``?``."""
    return name.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else T.quoted(c) for c in pattern) + "$")


def smoke(notes: DataFrame, checks: list[dict]) -> DataFrame:
    """(check, passed, n) for assertions on ``notes`` (zone, path, name, size, fields), counted in one pass.

    Kinds: count_type, contains, exists, glob (each at least ``least`` notes of a zone),
    file (a path is there) and health (and has 50 bytes).
    """

    def hits(c: dict) -> Column:
        zone = F.col("zone") == c.get("zone", "")
        value = F.coalesce(F.col("fields")[c.get("field", "type")], F.lit(""))
        return {
            "count_type": lambda: zone & (value == c["value"]),
            "contains": lambda: zone & F.contains(value, F.lit(c["value"])),
            "exists": lambda: zone & ~value.isin("", "[]"),
            "glob": lambda: zone & glob(F.col("name"), c["value"]),
            "file": lambda: F.col("path") == c["path"],
            "health": lambda: (F.col("path") == c["path"]) & (F.col("size") >= 50),
        }[c["kind"]]()

    row = notes.agg(*[F.count_if(hits(c)).alias(f"n{i}") for i, c in enumerate(checks)])
    out = F.array(*[F.struct(F.lit(c["name"]).alias("check"), (F.col(f"n{i}") >= c.get("least", 1)).alias("passed"), F.col(f"n{i}").alias("n")) for i, c in enumerate(checks)])
    return row.select(F.inline(out))


def epistemics(zone: Column) -> tuple[Column, Column]:
    """A zone's default claim type and confidence."""
    kind = F.coalesce(*[F.when(zone.isin(*zones), F.lit(c)) for zones, c, _ in EPISTEMICS if c])
    return kind, F.coalesce(*[F.when(zone.isin(*zones), F.lit(x)) for zones, _, x in EPISTEMICS])


def contract_age(text: Column, today: str, most: int = 30) -> Column:
    """missing, undated, old or fresh, by the day that the contract states."""
    age = dates.age_days(dates.stated_day(text), today)
    return F.when(text.isNull(), "missing").when(age.isNull(), "undated").when(age > most, "old").otherwise("fresh")


def overdue(at: Column, now: str, hours: int) -> Column:
    """More than so many hours before ``now``; the rules on handoffs, inbox notes, backups, catalogues and evaluations differ in the number."""
    return F.coalesce(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at) > hours * 3600, F.lit(False))


def stale_handoffs(handoffs: DataFrame, threads: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """(project, last_updated, n_open) of ``handoffs`` (project, last_updated) more than so many hours old that still have an open one of ``threads`` (project, status).

    Threads are counted by project first, so no project's threads meet. A handoff without a date is not old.
    """
    still = threads.where(F.lower("status") == "open").groupBy("project").agg(F.count("*").alias("n_open"))
    return handoffs.where(overdue(F.col("last_updated"), now, hours)).join(still, "project").select("project", "last_updated", "n_open")


def tidy(folder: Column, n_files: Column, today: str, days: int = 30) -> Column:
    """Whether a dated folder is empty and older than ``days``; one whose name is no date stays."""
    day = F.when(folder.rlike(r"^\d{4}-\d{2}-\d{2}$"), dates.parse(folder))
    return F.coalesce((n_files == 0) & (day < F.date_sub(F.lit(today).cast("date"), days)), F.lit(False))


def section_freshness(notes: DataFrame, headings: list[str], today: str, key: str = "path", text: str = "text", days: int = 14) -> DataFrame:
    """(key, heading, touched, state) of the sections with a heading of the vocabulary: stale beyond ``days`` since ``Last touched:``, unmarked without it."""
    lines = notes.select(key, F.posexplode(F.split(text, "\n")).alias("number", "line"))
    heading = F.when(F.startswith("line", F.lit("## ")), F.trim(F.substring("line", 4, 10_000)))
    w = Window.partitionBy(key).orderBy("number")  # the lines of one note
    touched = dates.parse(F.regexp_extract("line", r"(?i)^Last touched:\s*(\S+)", 1))
    rows = lines.select(key, F.last(heading, ignorenulls=True).over(w).alias("heading"), touched.alias("touched")).where(F.col("heading").isin(headings))
    out = rows.groupBy(key, "heading").agg(F.max("touched").alias("touched"))
    age = dates.age_days(F.col("touched"), today)
    return out.withColumn("state", F.when(age.isNull(), "unmarked").when(age > days, "stale").otherwise("fresh"))


def lessons(lines: DataFrame, key: str, number: str, text: str, status: str = "applied-twice") -> DataFrame:
    """(key, header) of the log's ``##`` blocks whose ``status:`` line says ``status``."""
    header = F.when(F.startswith(text, F.lit("## ")), F.substring(text, 4, 10_000))
    w = Window.partitionBy(key).orderBy(number)  # the lines of one log
    said = F.regexp_extract(text, r"^\W*status\W*:\W*([\w-]+)", 1)
    rows = lines.select(key, F.last(header, ignorenulls=True).over(w).alias("header"), said.alias("said"))
    return rows.where(F.col("header").isNotNull() & (F.col("said") == status)).select(key, "header").distinct()


def chain_drift(entries: Column, commits: Column, tolerance: int = 5, alarm: int = 10) -> Column:
    """ok within the tolerance, alarm beyond the second bound, drift between."""
    gap = F.abs(entries - commits)
    return F.when(gap <= tolerance, "ok").when(gap > alarm, "alarm").otherwise("drift")


def footprint(files: DataFrame, expected: list[str], root: str = "root", path: str = "path", size: str = "size") -> DataFrame:
    """(root, folder, n_files, bytes, present) of each expected folder of every root."""
    rows = files.select(root, F.split(path, "/")[0].alias("folder"), F.col(size).alias("bytes")).groupBy(root, "folder").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"))
    wanted = files.select(root).distinct().withColumn("folder", F.explode(F.array(*map(F.lit, expected))))
    out = wanted.join(rows, [root, "folder"], "left")
    return out.select(root, "folder", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.col("n_files").isNotNull().alias("present"))


def substrate(files: DataFrame, markers: dict[str, list[str]], root: str = "root", path: str = "path") -> DataFrame:
    """(root, substrate): the first kind all of whose markers are there as a file or a folder, else UNKNOWN."""
    has = lambda m: F.max(((F.col(path) == m) | F.startswith(path, F.lit(m.rstrip("/") + "/"))).cast("int")) == 1
    found = [F.when(reduce(Column.__and__, map(has, needed)), F.lit(kind)) for kind, needed in markers.items()]
    return files.groupBy(root).agg(F.coalesce(*found, F.lit("UNKNOWN")).alias("substrate"))


def baseline(files: DataFrame, guide: str, language: str | None = None) -> DataFrame:
    """(root, fault) of a project's set-up: its guide's markers, its write zone, log, handoff and operating guide. ``files``: root, path, text; ``language``: a column with each root's language."""
    held = lambda path: F.max(F.when(F.col("path") == path, F.col("text")))
    named = {"guide": held(guide), "zone": F.max(F.split("path", "/")[0].isin(*WRITE_ZONES) & F.contains("path", F.lit("/")))}
    for kind, name in (("log", "_auto_writes.md"), ("handoff", "_session_handoff.md")):
        named[kind] = F.coalesce(*[held(f"{zone}/{name}") for zone in WRITE_ZONES])
    named["operating"] = F.coalesce(*map(held, GUIDES))
    named["tongue"] = F.max(language) if language else F.lit(None).cast("string")
    rows = files.groupBy("root").agg(*[c.alias(n) for n, c in named.items()])
    text = F.coalesce("guide", F.lit(""))
    steps = reduce(Column.__add__, [F.contains(text, F.lit(f"Step {i}")).cast("int") for i in range(5)])
    foreign = ~F.lower(F.coalesce("tongue", F.lit(""))).isin("", "en", "english")
    has_guide = F.col("guide").isNotNull()
    faults = [F.when(~has_guide, "no_guide")]
    faults += [F.when(has_guide & ~T.contains_any(text, list(markers)), fault) for fault, markers in GUIDE_MARKERS]
    faults += [F.when(has_guide & (steps < 4), "cascade"), F.when(has_guide & foreign & ~T.contains_any(text, list(FOREIGN_MARKERS)), "language_caveat")]
    faults += [F.when(~F.coalesce("zone", F.lit(False)), "write_zone"), F.when(F.col("log").isNull(), "no_log").when(~F.col("log").rlike(r"type:\s*(log|audit)"), "log_type")]
    faults += [F.when(F.col("handoff").isNull(), "no_handoff").when(~F.col("handoff").rlike(r"last_updated:\s*\S"), "handoff_date"), F.when(F.col("operating").isNull(), "no_operating_guide")]
    return rows.select("root", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def structure(files: DataFrame, bases: list[str], rules: list[str], today: str, anchors: int = 13) -> DataFrame:
    """(root, check, passed, missing) of five checks on a project's files (root, path, text): bases, guide anchors, rules, plan links, contract age. The sixth, ``base_checks``, has its own table."""
    held = lambda path: F.max(F.when(F.col("path") == path, F.col("text")))
    paths = F.collect_set(F.when(F.col("path").rlike(r"\.(base|md|html)$"), F.col("path")))  # the settings and plans of one project
    rows = files.groupBy("root").agg(paths.alias("paths"), held("90 System/_operating_guide.md").alias("guide"), held("_plans_index.md").alias("index"), held("90 System/_retrieval_contract.md").alias("contract"))
    lacking = lambda folder, names: F.array_except(F.array(*[F.lit(f"{folder}/{n}") for n in names]), "paths")
    labels = F.array(*[F.struct(F.lit(f"P-{i}").alias("name"), F.col("guide").rlike(rf"\bP-{i}\b").alias("there")) for i in range(1, anchors + 1)])
    links = F.transform(T.reference_links(F.coalesce("index", F.lit(""))), lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""))
    state = contract_age(F.col("contract"), today)
    check = lambda name, missing: F.struct(F.lit(name).alias("check"), (F.size(missing) == 0).alias("passed"), F.array_join(F.array_sort(missing), ",").alias("missing"))
    absent = lambda column, name, missing: F.when(F.col(column).isNull(), F.array(F.lit(name))).otherwise(missing)
    checks = F.array(
        check("bases", lacking("90 System/Bases", bases)),
        check("operating_guide", absent("guide", "_operating_guide.md", F.transform(F.filter(labels, lambda x: ~x["there"]), lambda x: x["name"]))),
        check("rules_files", lacking(".claude/rules", rules)),
        check("plans_index", absent("index", "_plans_index.md", F.array_distinct(F.array_except(links, "paths")))),
        check("retrieval_contract", F.when(state == "fresh", F.array().cast("array<string>")).otherwise(F.array(state))),
    )
    return rows.select("root", F.inline(checks))


def recall(seeded: DataFrame, found: DataFrame, clean: DataFrame, key: str, kind: str, bar: float = 0.05) -> DataFrame:
    """(kind, n_seeded, n_found, recall, n_false, false_share, ok) of a lint on seeded faults (key, kind), given its findings (key, kind) and the unspoilt keys."""
    hit = seeded.join(found.select(key, kind).distinct().withColumn("hit", F.lit(1)), [key, kind], "left")
    per = hit.groupBy(kind).agg(F.count("*").alias("n_seeded"), F.count("hit").alias("n_found"))
    wrong = found.select(key, kind).distinct().join(clean.select(key).distinct(), key, "left_semi").groupBy(kind).agg(F.count("*").alias("n_false"))
    total = clean.select(key).distinct().agg(F.count("*").alias("n_clean"))
    rows = per.join(wrong, kind, "left").crossJoin(total)  # one row
    share = F.round(F.coalesce("n_false", F.lit(0)) / F.greatest("n_clean", F.lit(1)), 6)
    return rows.select(kind, "n_seeded", "n_found", F.round(F.col("n_found") / F.col("n_seeded"), 6).alias("recall"), F.coalesce("n_false", F.lit(0)).alias("n_false"), share.alias("false_share"), (share <= bar).alias("ok"))


# The closed vocabulary of types, the zones whose writers may use others, the flags of staleness,
# the kinds of claim, and the types that should state theirs.
KNOWN_TYPES = ("person", "company", "project", "meeting", "source", "concept", "decision", "guide", "contract", "log", "handoff", "handoff_archive", "eval", "inbox", "daily", "template", "base", "system")
FREE_ZONES = ("00 Inbox/", "80 Daily/", "99 Workspace/")
STALE_FLAGS = ("pending", "confirmed", "cleared")
CLAIMS = ("evidence", "inference", "hypothesis")
CLAIMING_TYPES = ("person", "company", "project", "meeting", "source", "concept", "decision")


def vocabulary(notes: DataFrame) -> DataFrame:
    """(path, rule, kind) of ``notes`` (path, type, stale, claim_type): values outside their vocabulary are violations, a claim type that is not stated is a signal.

    Types are free in FREE_ZONES and at the root. Flags and claims count without
    spaces, quotes and case; blank ones pass, and a null claim type is one not stated.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.trim(c), "^['\"]+|['\"]+$", ""))
    bound = F.contains("path", F.lit("/")) & ~F.col("path").rlike("^(" + "|".join(FREE_ZONES) + ")")
    wrong = lambda c, known: F.col(c).isNotNull() & (F.trim(c) != "") & ~plain(c).isin(*known)
    found = F.array(
        F.when(bound & F.col("type").isNotNull() & ~F.col("type").isin(*KNOWN_TYPES), F.struct(F.lit("type_vocab").alias("rule"), F.lit("violation").alias("kind"))),
        F.when(wrong("stale", STALE_FLAGS), F.struct(F.lit("stale_enum").alias("rule"), F.lit("violation").alias("kind"))),
        F.when(wrong("claim_type", CLAIMS), F.struct(F.lit("claim_type").alias("rule"), F.lit("violation").alias("kind"))),
        F.when(F.col("claim_type").isNull() & F.col("type").isin(*CLAIMING_TYPES), F.struct(F.lit("claim_type").alias("rule"), F.lit("signal").alias("kind"))),
    )
    return notes.select("path", F.explode(F.array_compact(found)).alias("f")).select("path", "f.rule", "f.kind")
