"""Rules over parsed workflows: tables of workflows, their steps and the actions that they use."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scales import lookup
from ledgerloom.sources.samples import matches, one_of, over, sample

# Owners of the platform, forms of references, events that outsiders can start, what they write, scopes that write.
PLATFORM = ("actions", "github")
REFERENCES = (("sha", r"^[0-9a-f]{40}$"), ("release-tag", r"^v?[0-9]+\.[0-9]+\.[0-9]+([-+.].*)?$"), ("floating-tag", r"^v?[0-9]+(\.[0-9]+)?$"))
UNTRUSTED_EVENTS = (
    "pull_request_target", "issue_comment", "issues", "discussion", "discussion_comment", "pull_request_review", "pull_request_review_comment", "workflow_run", "fork", "watch",
)
# Fields of the event that an outsider writes: texts by their path, and objects of which any member counts.
WRITTEN_TEXTS = (
    "comment.body", "discussion.body", "discussion.title", "issue.body", "issue.title", "pull_request.body", "pull_request.head.label", "pull_request.head.ref",
    "pull_request.title", "review.body", "review_comment.body", "workflow_run.head_branch", "workflow_run.head_commit",
)
WRITTEN_OBJECTS = ("commits", "head_commit", "inputs", "pages", "pull_request.head.repo")
HEAD_OBJECTS = ("pull_request.head", "workflow_run.head")
WRITE_SCOPES = ("contents", "packages", "pull-requests", "issues", "actions", "deployments", "pages", "statuses", "checks", "security-events", "discussions")
# Words in a credential's name that say it only posts messages; words that name a deployment; commands that print; sinks that are shown.
MESSAGING = ("slack", "discord", "teams", "mattermost", "webhook", "notification")
DEPLOYMENTS = ("deploy", "release", "publish", "promote", "rollout", "cd")
PRINTERS = ("echo", "printf", "print", "cat", "tee", "console.log")
SHOWN_SINKS = ("$GITHUB_STEP_SUMMARY", "${GITHUB_STEP_SUMMARY}")
_EVENT = r"github\.event\.([A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*)"
_HEAD = r"github\.head_ref\b"
_SECRET = r"\$\{\{\s*secrets\.([A-Za-z0-9_]+)"
_QUOTED = r"""\"(\\.|[^\"\\])*(\"|$)|'[^']*('|$)"""
_PRINTED = r"^(?:.*[\s;&|(])?(?:" + "|".join(re.escape(c) for c in PRINTERS) + r")\b(.*)$"
# Severities by trust and mutability, and by trust and credential; one step up with a broad one, one down where pinned.
UNPINNED = {("third-party", "branch"): "high", ("third-party", "floating-tag"): "medium", ("third-party", "release-tag"): "low", ("same-owner", "branch"): "medium", ("same-owner", "floating-tag"): "low", ("same-owner", "release-tag"): "low"}
HANDED = {("third-party", "broad"): "high", ("third-party", "narrow"): "medium", ("same-owner", "broad"): "medium", ("same-owner", "narrow"): "low"}
RAISED = {"low": "medium", "medium": "high", "high": "critical"}
LOWERED = {"high": "medium", "medium": "low", "low": "low"}


def _by_two(a: str, b: str, grid: dict) -> Column:
    return lookup(F.concat_ws("/", a, b), {"/".join(k): v for k, v in grid.items()})


def credential_class(name: Column) -> Column:
    return F.when(F.upper(F.trim(name)) == "GITHUB_TOKEN", "auto-token").when(F.arrays_overlap(F.split(F.lower(name), "_"), F.array(*map(F.lit, MESSAGING))), "narrow").when(name.isNotNull(), "broad")


def _names_deployment(text: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"\W+"), F.array(*map(F.lit, DEPLOYMENTS)))


def outsider_writes(expression: Column) -> Column:
    """Whether an expression reads a text that somebody without write access can choose."""
    fields = F.regexp_extract_all(expression, F.lit(_EVENT), 1)
    inside = lambda f: reduce(lambda a, b: a | b, [f.startswith(o + ".") for o in WRITTEN_OBJECTS])
    texts = F.arrays_overlap(F.transform(fields, lambda f: f), F.array(*map(F.lit, WRITTEN_TEXTS)))
    below = F.exists(fields, lambda f: inside(f) | reduce(lambda a, b: a | b, [f.startswith(t + ".") for t in WRITTEN_TEXTS]))
    return expression.rlike(_HEAD) | texts | below


def _outsider_head(text: Column) -> Column:
    return F.exists(F.regexp_extract_all(text, F.lit(_EVENT), 1), lambda f: reduce(lambda a, b: a | b, [f.startswith(o) for o in HEAD_OBJECTS]))


def printed(line: Column, secret_at: Column) -> Column:
    """Whether the command that holds a secret at a place of its line (from 1) writes it to the log.

    The nearest printing command before the secret counts, to the end of that command: quoted text is
    no shell syntax, a pipe hides the output unless it goes to tee, a file hides it unless the file
    is a descriptor or is shown with the run.
    """
    before = F.substring(line, F.lit(1), secret_at - 1)
    rest = F.concat(F.regexp_extract(before, _PRINTED, 1), F.substring(line, secret_at, F.char_length(line)))
    command = F.regexp_extract(F.regexp_replace(rest, _QUOTED, ""), r"^((?:[^;&|]|&(?!&)|\|(?!\|))*)", 1)
    turn = F.regexp_extract(command, r"^[^|>]*(\||>)", 1)
    sink = F.regexp_extract(command, r"^[^|>]*(?:\||>+)\s*(\S*)", 1)
    shown = F.when(turn == "", True).when(turn == "|", sink == "tee").otherwise(sink.startswith("&") | sink.isin(*SHOWN_SINKS))
    return before.rlike(_PRINTED) & shown


def action_references(rows: DataFrame) -> DataFrame:
    """Owner, path, reference, trust and mutability of what a step uses; local paths and texts without a reference have none."""
    value = F.trim("uses")
    docker = value.startswith("docker://")
    image = F.substring(value, 10, 10_000)
    path, ref = F.regexp_extract(value, "^(.*)@([^@]*)$", 1), F.regexp_extract(value, "^(.*)@([^@]*)$", 2)
    rows = rows.withColumns({
        "__docker": docker, "reference": F.when(docker, F.when(F.contains(image, F.lit("@sha256:")), "sha256").otherwise(F.coalesce(F.get(F.split(image, ":"), F.lit(1)), F.lit("latest")))).otherwise(ref),
        "repository": F.when(docker, F.split(image, ":")[0]).otherwise(path), "vendor": F.when(docker, "docker").otherwise(F.split(path, "/")[0]),
    })
    rows = rows.where(~F.trim("uses").startswith("./") & (F.col("__docker") | ((F.col("vendor") != "") & F.contains("repository", F.lit("/")))))
    mutability = F.lit("branch")
    for name, pattern in reversed(REFERENCES):
        mutability = F.when(F.col("reference").rlike(pattern), name).otherwise(mutability)
    trust = F.when(F.col("__docker"), "third-party").when(F.lower("vendor").isin(*PLATFORM), "platform").when(F.lower("vendor") == F.lower("owner"), "same-owner").otherwise("third-party")
    return rows.withColumns({
        "mutability": F.when(F.col("__docker") & (F.col("reference") == "sha256"), "sha").otherwise(mutability), "trust": trust,
        "reusable": F.contains("repository", F.lit("/.github/workflows/")), "credential": credential_class(F.col("secret")),
    }).drop("__docker")


def _unpinned_severity() -> Column:
    base = _by_two("trust", "mutability", UNPINNED)
    return F.when(F.col("credential") == "broad", lookup(base, RAISED)).otherwise(base)


def _trigger_severity() -> Column:
    writes = F.exists(F.split("permissions", ","), lambda p: p.endswith(":write") & F.split(p, ":")[0].isin(*WRITE_SCOPES))
    return F.when(F.col("permissions").isNull() | (F.col("permissions") == "write-all") | writes, "high").otherwise("medium")


def unpinned_actions(refs: DataFrame) -> DataFrame:
    """Actions outside the platform that no commit pins; a broad credential raises the severity by a step."""
    hit = refs.where("mutability <> 'sha' and trust <> 'platform'")
    return hit.select("use_id", "workflow", "job", "repository", _unpinned_severity().alias("severity"))


def platform_actions(refs: DataFrame, listed: int = 20) -> DataFrame:
    """One row a workflow for the platform's actions that no commit pins."""
    hit = refs.where("mutability <> 'sha' and trust = 'platform'")
    return hit.groupBy("workflow").agg(F.count("*").alias("references"), F.array_join(F.slice(F.array_sort(F.collect_set("uses")), 1, listed), ",").alias("uses"))


def secrets_to_actions(refs: DataFrame) -> DataFrame:
    """Secrets handed to actions outside the platform; the job's own token is recorded as suppressed."""
    hit = refs.where("trust <> 'platform' and credential is not null").withColumn("base", _by_two("trust", "credential", HANDED))
    severity = F.when(F.col("mutability") == "sha", lookup(F.col("base"), LOWERED)).otherwise(F.col("base"))
    return hit.select("use_id", "workflow", "secret", F.when(F.col("credential") == "auto-token", None).otherwise(severity).alias("severity"), (F.col("credential") == "auto-token").alias("suppressed"))


def events_of(workflows: DataFrame) -> DataFrame:
    events = F.split("triggers", ",")
    return workflows.withColumns({"events": events, "untrusted": F.arrays_overlap(events, F.array(*map(F.lit, UNTRUSTED_EVENTS)))})


def untrusted_checkouts(steps: DataFrame, workflows: DataFrame) -> DataFrame:
    """Steps that check out an outsider's head under an event that holds the repository's secrets."""
    risky = events_of(workflows).where(F.arrays_overlap("events", F.array(F.lit("pull_request_target"), F.lit("workflow_run")))).select("workflow")
    ref = F.coalesce(F.col("checkout_ref"), F.lit(""))
    head = _outsider_head(ref) | ref.rlike(_HEAD) | _outsider_head(F.col("script"))
    return steps.where(head).join(risky, "workflow", "left_semi").select("step_id", "workflow", "job")


def script_injections(steps: DataFrame) -> DataFrame:
    """The first expression in a script that an outsider writes."""
    inside = F.transform(F.regexp_extract_all("script", F.lit(r"\$\{\{([^}]*)\}\}"), 1), lambda x: F.trim(x))
    bad = F.get(F.filter(inside, outsider_writes), F.lit(0))
    return steps.select("step_id", "workflow", "job", bad.alias("expression")).where("expression is not null")


def _with_permission_rule(wf: DataFrame) -> DataFrame:
    scopes = F.array_join(F.transform(F.filter(F.split(F.coalesce("permissions", F.lit("")), ","), lambda p: p.endswith(":write")), lambda p: F.split(p, ":")[0]), ",")
    wf = wf.withColumn("scopes", scopes)
    rule = F.when(F.col("permissions").isNull(), "undeclared").when(F.col("permissions") == "write-all", "write-all").when(F.col("scopes") != "", "workflow-wide")
    severity = F.when(F.col("rule") == "write-all", "high").when(F.col("rule") == "undeclared", F.when(F.col("untrusted"), "high").otherwise("medium")).otherwise(F.when(F.col("untrusted"), "medium").otherwise("low"))
    return wf.withColumn("rule", rule).withColumn("rule_severity", severity)


def permission_rules(workflows: DataFrame) -> DataFrame:
    """Workflows without permissions, with all of them, or with write scopes for every job."""
    return _with_permission_rule(events_of(workflows)).where("rule is not null").select("workflow", "rule", F.col("rule_severity").alias("severity"), "scopes")


def secrets_in_scripts(steps: DataFrame) -> DataFrame:
    """The first secret spliced into each line of a script: written to the log, or in a command line only."""
    lines = steps.select("step_id", "workflow", F.posexplode(F.split("script", r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("secret", F.regexp_extract("line", _SECRET, 1)).where("secret <> ''")
    logged = printed(F.col("line"), F.regexp_instr("line", F.lit(_SECRET)))
    return lines.select("step_id", "workflow", (F.col("at") + 1).alias("line"), "secret", F.when(logged, "secret-echoed").otherwise("secret-in-run").alias("rule"), F.when(logged, "high").otherwise("medium").alias("severity"))


def missing_concurrency(steps: DataFrame, workflows: DataFrame) -> DataFrame:
    """Deployment jobs, by the name of the job or its workflow, without a concurrency group."""
    jobs = steps.select("workflow", "job").distinct().join(workflows.where("concurrency is null").select("workflow", "name"), "workflow")
    return jobs.where(_names_deployment(F.col("job")) | _names_deployment(F.col("name")) | _names_deployment(F.col("workflow"))).select("workflow", "job")


def self_hosted(steps: DataFrame, workflows: DataFrame) -> DataFrame:
    """Jobs on runners of one's own, worse where an outsider can start them."""
    own = F.exists(F.split("runner", ","), lambda x: F.lower(F.trim(x)) == "self-hosted")
    jobs = steps.where(own).select("workflow", "job").distinct().join(events_of(workflows).select("workflow", "untrusted"), "workflow")
    return jobs.select("workflow", "job", F.when(F.col("untrusted"), "high").otherwise("medium").alias("severity"))


def untrusted_with_secrets(steps: DataFrame, workflows: DataFrame) -> DataFrame:
    """Workflows that outsiders can start and that hold secrets; `also` tells whether a checkout or an injection makes it worse."""
    wf = events_of(workflows).where("untrusted")
    holds = steps.where(F.col("script").rlike(r"\$\{\{\s*secrets\.")).select("workflow").distinct().withColumn("holds", F.lit(True))
    reported = untrusted_checkouts(steps, workflows).select("workflow").union(script_injections(steps).select("workflow")).distinct().withColumn("also", F.lit(True))
    wf = wf.join(holds, "workflow", "left").join(reported, "workflow", "left").where("holds or permissions = 'write-all'")
    return wf.select("workflow", _trigger_severity().alias("severity"), F.coalesce("also", F.lit(False)).alias("also"))


def workflow_findings(steps: DataFrame, workflows: DataFrame, uses: DataFrame) -> DataFrame:
    """All rules as one table of (rule, workflow, subject, severity); suppressed rows stay out.

    Steps meet their workflow once; what a step, a job and a workflow show is gathered from those rows.
    """
    text = lambda c: c.cast("string")
    hit = lambda when, rule, subject, severity: F.when(when, F.struct(F.lit(rule).alias("rule"), text(subject).alias("subject"), severity.alias("severity")))
    stack = lambda df, *hits: df.select("workflow", F.inline(F.array_compact(F.array(*hits)))).select("rule", "workflow", "subject", "severity")
    refs = action_references(uses)
    wf = _with_permission_rule(events_of(workflows))
    known = steps.join(wf.select("workflow", "events", "untrusted", "permissions", F.col("concurrency").isNull().alias("free"), _names_deployment(F.concat_ws(" ", "name", "workflow")).alias("deploys")), "workflow", "left")
    ref = F.coalesce(F.col("checkout_ref"), F.lit(""))
    risky = F.coalesce(F.arrays_overlap("events", F.array(F.lit("pull_request_target"), F.lit("workflow_run"))), F.lit(False))
    known = known.withColumns({
        "checkout": risky & (_outsider_head(ref) | ref.rlike(_HEAD) | _outsider_head(F.col("script"))),
        "injection": F.exists(F.regexp_extract_all("script", F.lit(r"\$\{\{([^}]*)\}\}"), 1), outsider_writes),
        "holds": F.col("script").rlike(_SECRET), "own": F.exists(F.split("runner", ","), lambda x: F.lower(F.trim(x)) == "self-hosted"),
    })
    jobs = known.where("untrusted is not null").groupBy("workflow", "job").agg(
        F.bool_or(F.col("free") & (F.col("deploys") | _names_deployment(F.col("job")))).alias("open"), F.bool_or("own").alias("own"), F.bool_or("untrusted").alias("untrusted"))
    shown = known.groupBy("workflow").agg(F.bool_or("holds").alias("holds"), F.bool_or(F.col("checkout") | F.col("injection")).alias("also"))
    triggers = wf.where("untrusted").join(shown, "workflow", "left").where("holds or permissions = 'write-all'")
    secret = F.when(F.col("trust") != "platform", _by_two("trust", "credential", HANDED))
    secret = F.when(F.col("mutability") == "sha", lookup(secret, LOWERED)).otherwise(secret)
    parts = [
        stack(known, hit(F.col("checkout"), "target-checkout", F.col("step_id"), F.lit("critical")), hit(F.col("injection"), "script-injection", F.col("step_id"), F.lit("high"))),
        secrets_in_scripts(steps).select(F.lit("secret-in-script").alias("rule"), "workflow", text(F.col("step_id")).alias("subject"), "severity"),
        stack(jobs, hit(F.col("open"), "missing-concurrency", F.col("job"), F.lit("medium")), hit(F.col("own"), "self-hosted-runner", F.col("job"), F.when(F.col("untrusted"), "high").otherwise("medium"))),
        stack(triggers, hit(F.lit(True), "untrusted-trigger", F.lit("trigger"), _trigger_severity())),
        stack(wf, hit(F.col("rule").isNotNull(), "permissions", F.col("rule"), F.col("rule_severity"))),
        stack(
            refs,
            hit((F.col("mutability") != "sha") & (F.col("trust") != "platform"), "unpinned-action", F.col("use_id"), _unpinned_severity()),
            hit((F.col("trust") != "platform") & F.col("credential").isin("narrow", "broad"), "secret-to-action", F.col("use_id"), secret),
        ),
        platform_actions(refs).select(F.lit("unpinned-platform-action").alias("rule"), "workflow", F.lit("platform-actions").alias("subject"), F.lit("low").alias("severity")),
    ]
    return reduce(DataFrame.unionByName, parts)


_steps, _wf, _uses = (lambda n: lambda s, d: sample(s, d, n))("run_step"), (lambda n: lambda s, d: sample(s, d, n))("workflow"), (lambda n: lambda s, d: sample(s, d, n))("uses")
QUERIES = {
    "prj37_action_references": lambda s, d: action_references(_uses(s, d)).select("use_id", "vendor", "repository", "reference", "mutability", "trust", "reusable", "credential"),
    "rul21_unpinned_actions": lambda s, d: unpinned_actions(action_references(_uses(s, d))),
    "rul22_platform_actions": lambda s, d: platform_actions(action_references(_uses(s, d))),
    "rul23_untrusted_checkouts": lambda s, d: untrusted_checkouts(_steps(s, d), _wf(s, d)),
    "rul24_script_injections": lambda s, d: script_injections(_steps(s, d)),
    "rul25_permissions": lambda s, d: permission_rules(_wf(s, d)),
    "rul26_secrets_in_scripts": lambda s, d: secrets_in_scripts(_steps(s, d)),
    "rul27_secrets_to_actions": lambda s, d: secrets_to_actions(action_references(_uses(s, d))),
    "rul28_missing_concurrency": lambda s, d: missing_concurrency(_steps(s, d), _wf(s, d)),
    "rul29_self_hosted": lambda s, d: self_hosted(_steps(s, d), _wf(s, d)),
    "rul30_untrusted_triggers": lambda s, d: untrusted_with_secrets(_steps(s, d), _wf(s, d)),
    "set01_workflow_findings": lambda s, d: workflow_findings(_steps(s, d), _wf(s, d), _uses(s, d)),
}
_REFS = f"""SELECT *, CASE WHEN docker THEN 'third-party' WHEN lower(vendor) IN {one_of(PLATFORM)} THEN 'platform' WHEN lower(vendor) = lower(owner) THEN 'same-owner' ELSE 'third-party' END AS trust,
 CASE WHEN docker AND reference = 'sha256' THEN 'sha' {" ".join(f"WHEN {matches('reference', p)} THEN '{n}'" for n, p in REFERENCES)} ELSE 'branch' END AS mutability, contains(repository, '/.github/workflows/') AS reusable,
 CASE WHEN secret = 'GITHUB_TOKEN' THEN 'auto-token' WHEN len(list_intersect(string_split(lower(secret), '_'), {list(MESSAGING)})) > 0 THEN 'narrow' WHEN secret IS NOT NULL THEN 'broad' END AS credential FROM
 (SELECT *, starts_with(v, 'docker://') AS docker, CASE WHEN starts_with(v, 'docker://') THEN CASE WHEN contains(v, '@sha256:') THEN 'sha256' ELSE coalesce(nullif(split_part(substr(v, 10), ':', 2), ''), 'latest') END ELSE string_split(v, '@')[-1] END AS reference,
  CASE WHEN starts_with(v, 'docker://') THEN split_part(substr(v, 10), ':', 1) ELSE regexp_replace(v, '@[^@]*$', '') END AS repository, CASE WHEN starts_with(v, 'docker://') THEN 'docker' ELSE split_part(v, '/', 1) END AS vendor
  FROM (SELECT *, trim(uses) AS v FROM s_uses)) WHERE NOT starts_with(v, './') AND (docker OR (contains(v, '@') AND contains(repository, '/')))"""
_TWO = lambda a, b, grid: f"CASE {a} || '/' || {b} " + " ".join(f"WHEN '{x}/{y}' THEN '{v}'" for (x, y), v in grid.items()) + " END"
_UNP = f"SELECT use_id, workflow, job, repository, CASE WHEN credential = 'broad' THEN CASE b WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END ELSE b END AS severity FROM (SELECT *, {_TWO('trust', 'mutability', UNPINNED)} AS b FROM refs) WHERE mutability <> 'sha' AND trust <> 'platform'"
_PLAT = "SELECT workflow, count(*) AS \"references\", array_to_string(list_sort(list(DISTINCT uses))[1:20], ',') AS uses FROM refs WHERE mutability <> 'sha' AND trust = 'platform' GROUP BY workflow"
_EV = f"SELECT *, string_split(triggers, ',') AS e, len(list_intersect(string_split(triggers, ','), [{', '.join(repr(x) for x in UNTRUSTED_EVENTS)}])) > 0 AS untrusted FROM s_workflow"
_FIELDS = "regexp_extract_all({}, 'github[.]event[.]([A-Za-z0-9_]+(?:[.][A-Za-z0-9_]+)*)', 1)"
_HEADS = lambda c: f"len(list_filter({_FIELDS.format(c)}, lambda f: starts_with(f, 'pull_request.head') OR starts_with(f, 'workflow_run.head'))) > 0"
_CHK = f"SELECT step_id, workflow, job FROM s_run_step WHERE (coalesce({_HEADS('checkout_ref')}, false) OR coalesce(regexp_matches(checkout_ref, 'github[.]head_ref'), false) OR {_HEADS('script')}) AND workflow IN (SELECT workflow FROM ev WHERE list_contains(e, 'pull_request_target') OR list_contains(e, 'workflow_run'))"
_WRITES = f"(contains(x, 'github.head_ref') OR len(list_filter({_FIELDS.format('x')}, lambda f: list_contains({list(WRITTEN_TEXTS)}, f) OR " + " OR ".join(f"starts_with(f, '{o}.')" for o in (*WRITTEN_OBJECTS, *WRITTEN_TEXTS)) + ")) > 0)"
_INJ = f"SELECT * FROM (SELECT step_id, workflow, job, list_filter(list_transform(regexp_extract_all(script, '\\$\\{{\\{{([^}}]*)\\}}\\}}', 1), lambda x: trim(x)), lambda x: {_WRITES})[1] AS expression FROM s_run_step) WHERE expression IS NOT NULL"
_PERM = """SELECT workflow, rule, CASE WHEN rule = 'write-all' THEN 'high' WHEN rule = 'undeclared' THEN CASE WHEN untrusted THEN 'high' ELSE 'medium' END WHEN untrusted THEN 'medium' ELSE 'low' END AS severity, scopes FROM
 (SELECT *, CASE WHEN permissions IS NULL THEN 'undeclared' WHEN permissions = 'write-all' THEN 'write-all' WHEN scopes <> '' THEN 'workflow-wide' END AS rule FROM
 (SELECT *, coalesce(array_to_string(list_transform(list_filter(string_split(permissions, ','), lambda p: ends_with(p, ':write')), lambda p: split_part(p, ':', 1)), ','), '') AS scopes FROM ev)) WHERE rule IS NOT NULL"""
_CUT = "regexp_replace(regexp_replace(rest, '\"[^\"]*(\"|$)|''[^'']*(''|$)', '', 'g'), '(;|&&|[|][|]).*$', '')"
_SEC = f"""SELECT step_id, workflow, "line", secret, CASE WHEN l THEN 'secret-echoed' ELSE 'secret-in-run' END AS rule, CASE WHEN l THEN 'high' ELSE 'medium' END AS severity FROM
 (SELECT *, printer <> '' AND CASE WHEN NOT regexp_matches(cmd, '[|>]') THEN true WHEN regexp_extract(cmd, '[|>]') = '|' THEN trim(split_part(cmd, '|', 2)) = 'tee' OR starts_with(trim(split_part(cmd, '|', 2)), 'tee ')
   ELSE regexp_matches(cmd, '>\\s*(&|[$]GITHUB_STEP_SUMMARY|[$][{{]GITHUB_STEP_SUMMARY[}}])') END AS l FROM
 (SELECT *, {_CUT} AS cmd FROM (SELECT *, regexp_extract(t, '(^|[\\s;&|(])(echo|printf|print|cat|tee|console[.]log)\\b', 2) AS printer,
   regexp_extract(split_part(t, '${{{{', 1), '^(?:.*[\\s;&|(])?(?:echo|printf|print|cat|tee|console[.]log)\\b(.*)$', 1) || substr(t, instr(t, '${{{{')) AS rest, regexp_extract(t, 'secrets[.]([A-Za-z0-9_]+)', 1) AS secret FROM
 (SELECT step_id, workflow, unnest(string_split(script, chr(10))) AS t, generate_subscripts(string_split(script, chr(10)), 1) AS "line" FROM s_run_step) WHERE contains(t, '${{{{ secrets.'))))"""
_HAND = f"SELECT use_id, workflow, secret, CASE WHEN credential = 'auto-token' THEN NULL WHEN mutability = 'sha' THEN CASE b WHEN 'high' THEN 'medium' ELSE 'low' END ELSE b END AS severity, credential = 'auto-token' AS suppressed FROM (SELECT *, {_TWO('trust', 'credential', HANDED)} AS b FROM refs) WHERE trust <> 'platform' AND credential IS NOT NULL"
_DEP = lambda c: f"len(list_intersect(regexp_split_to_array(lower({c}), '[^a-z0-9_]+'), {list(DEPLOYMENTS)})) > 0"
_CONC = f"SELECT DISTINCT workflow, job FROM s_run_step JOIN s_workflow USING (workflow) WHERE concurrency IS NULL AND ({_DEP('job')} OR {_DEP('name')} OR {_DEP('workflow')})"
_SELF = "SELECT DISTINCT workflow, job, CASE WHEN untrusted THEN 'high' ELSE 'medium' END AS severity FROM s_run_step JOIN ev USING (workflow) WHERE list_contains(string_split(runner, ','), 'self-hosted')"
_UNT = f"""SELECT workflow, CASE WHEN permissions IS NULL OR permissions = 'write-all' OR {matches("permissions", "(^|,)(" + "|".join(WRITE_SCOPES) + "):write(,|$)")} THEN 'high' ELSE 'medium' END AS severity, workflow IN (SELECT workflow FROM chk UNION SELECT workflow FROM inj) AS also
 FROM ev WHERE untrusted AND (coalesce(permissions = 'write-all', false) OR workflow IN (SELECT workflow FROM s_run_step WHERE contains(script, '{{{{ secrets.')))"""
_VIEWS = ("uses", "workflow", "run_step")
_ALL = {"refs": _REFS, "ev": _EV, "unp": _UNP, "plat": _PLAT, "chk": _CHK, "inj": _INJ, "perm": _PERM, "sec": _SEC, "hand": _HAND, "conc": _CONC, "self_": _SELF, "unt": _UNT}
ORACLES = {
    "prj37_action_references": over("SELECT use_id, vendor, repository, reference, mutability, trust, reusable, credential FROM refs", "uses", refs=_REFS),
    "set01_workflow_findings": over(
        """SELECT 'unpinned-action' AS rule, workflow, CAST(use_id AS VARCHAR) AS subject, severity FROM unp UNION ALL SELECT 'unpinned-platform-action', workflow, 'platform-actions', 'low' FROM plat UNION ALL SELECT 'target-checkout', workflow, CAST(step_id AS VARCHAR), 'critical' FROM chk
 UNION ALL SELECT 'script-injection', workflow, CAST(step_id AS VARCHAR), 'high' FROM inj UNION ALL SELECT 'permissions', workflow, rule, severity FROM perm UNION ALL SELECT 'secret-in-script', workflow, CAST(step_id AS VARCHAR), severity FROM sec
 UNION ALL SELECT 'secret-to-action', workflow, CAST(use_id AS VARCHAR), severity FROM hand WHERE NOT suppressed UNION ALL SELECT 'missing-concurrency', workflow, job, 'medium' FROM conc UNION ALL SELECT 'self-hosted-runner', workflow, job, severity FROM self_ UNION ALL SELECT 'untrusted-trigger', workflow, 'trigger', severity FROM unt""", *_VIEWS, **_ALL),
} | {q: over(f"SELECT * FROM {t}", *_VIEWS, **_ALL) for q, t in (
    ("rul21_unpinned_actions", "unp"), ("rul22_platform_actions", "plat"), ("rul23_untrusted_checkouts", "chk"), ("rul24_script_injections", "inj"), ("rul25_permissions", "perm"),
    ("rul26_secrets_in_scripts", "sec"), ("rul27_secrets_to_actions", "hand"), ("rul28_missing_concurrency", "conc"), ("rul29_self_hosted", "self_"), ("rul30_untrusted_triggers", "unt"))}
