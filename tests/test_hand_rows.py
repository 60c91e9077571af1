"""Operators on rows written by hand, with the answers that the rules give."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.scales import DOMAINS, SEVERITIES, label_of
from ledgerloom.functions.text import version_gap
from ledgerloom.operators import grading, risk, scalars, scoring, texts, workflows


def judged(spark, cases, of):
    """of(column v) for every case against its answer."""
    rows = spark.createDataFrame([(i, v) for i, (v, *_) in enumerate(cases)], "i int, v string").select("i", of(F.col("v")).alias("found"))
    return [(cases[r["i"]][0], r["found"]) for r in rows.orderBy("i").collect()]


def test_a_run_without_a_scored_domain_has_no_worst_one(spark):
    schema = "run int, domain string, score int, effective_weight double, status string"
    unscored = [(1, d, None, 0.0, "not-assessed") for d in DOMAINS]
    weak = [(2, "appsec", 40, 30.0, "scored"), (2, "data", 40, 20.0, "scored"), (2, "api", 95, 0.01, "partial"), (2, "deadcode", None, 0.0, "not-assessed")]
    tie = [(3, "appsec", 50, 0.5, "scored"), (3, "data", 51, 0.5, "scored"), (3, "api", 50, 9.0, "scored")]  # 50.05 to one place
    found = {r["run"]: r for r in scoring.overall_scores(spark.createDataFrame(unscored + weak + tie, schema)).collect()}
    assert found[1]["worst_domain"] is None and found[1]["score"] is None and found[1]["limit_"] is None and found[1]["status"] == "not-assessed"
    assert (found[2]["worst_domain"], found[2]["limit_"], found[2]["weighted_mean"], found[2]["status"]) == ("appsec", 55, 40.0, "partial")
    assert found[3]["weighted_mean"] == 50.1 and found[3]["worst_domain"] == "appsec"


def test_labels_outside_a_scale_are_null(spark):
    rows = spark.createDataFrame([(None,), (-1,), (0,), (4,), (5,)], "r int").select(label_of(F.col("r"), SEVERITIES).alias("x"))
    assert [r["x"] for r in rows.collect()] == [None, None, "critical", "info", None]


FILES = [
    ("src/handlers/auth.ts", "production"), ("src/handlers/auth.test.ts", "test"), ("src/a.spec.cjs", "test"), ("dist/handlers.test.js", "generated"), ("node_modules/x/readme.md", "vendored"),
    ("README-TEST.md", "documentation"), ("docs/guide/example.ts", "documentation"), ("docs-public/index.ts", "documentation"), ("document/a.ts", "production"), (".env.example", "example"), ("a/config.sample", "example"),
    ("src/b2b.generated.spec.ts", "test"), ("src/b2b.generated.ts", "generated"), ("src/types.d.ts", "generated"), ("src/types.d.tsx", "production"), ("scripts/test-local.ts", "test"), ("scripts/local-test.mjs", "test"),
    ("latest.ts", "production"), ("src/x.mock.ts", "fixture"), ("src/x.stories.tsx", "fixture"), ("web/mocks/handlers.ts", "fixture"), ("a/__snapshots__/x.snap", "fixture"), ("charts/templates/tests/hook.yaml", "test"),
    ("libs/test-helpers/index.ts", "test"), ("e2e/login.ts", "test"), ("contest/a.ts", "production"), ("a\\__TESTS__\\b.ts", "test"), ("./build/x.js", "generated"), ("/abs/src/a.ts", "production"), ("Makefile", "production"),
    ("test.ts", "production"), ("src/.test.ts", "test"),
]


def test_file_kinds(spark):
    assert judged(spark, FILES, lambda v: grading.file_kind(grading.plain_path(v))) == FILES


VALUES = [
    ("changeme!", "placeholder"), ("<your-key>", "placeholder"), ("YOUR_KEY", "placeholder"), ("changeme-but-actually-a-long-random-key-9Qz", "credible"), ("123456789012345", "trivial"), ("abc456", "placeholder"),
    ("short9", "trivial"), ("aaaaaaaaaaaaaaaaaaaa", "trivial"), ("eyJhbGciOiJIUzI1NiIs", "placeholder"), ("eyJhbGciOiJIUzI1NiIs.eyJzdWIiOiIxMjM0.c2lnbmF0dXJl", "credible"), ("eyJhbGciOi...", "placeholder"),
    ("${TOKEN_FROM_ENV}", "placeholder"), ("{{ token }}", "placeholder"), ("my-secret", "placeholder"), ("the_token", "placeholder"), ("mysecret", "trivial"), ("q8Zr2LmT0vXy5Wb9", "credible"), ("", "placeholder"), (None, "unknown"),
]


def test_secret_values(spark):
    assert judged(spark, VALUES, grading.secret_value_shape) == VALUES


CALLERS = [
    ("session.user.id", True), ("session?.user", True), ("session", False), ("auth()", True), ("auth ( )", True), ("auth.uid()", True), ("authenticate()", False), ("await getServerSession(opts)", True), ("getSession()", True),
    ("currentUser", True), ("req.user", True), ("ctx.locals.user.id", True), ("request.auth", True), ("res.auth", False), ("this.principal", True), ("this.repo", False), ("user.id", True), ("user.name", False),
    ("userId", True), ("tenant_id", True), ("orgID", True), ("invoiceId", False), ("claims.sub", True), ("jwt.sub", True), ("token.sub", True), ("token.exp", False), ("row.total", False), ("1", False), ("", False), ("params.userId", True),
    ("event.locals.user", True), ("username", False), ("userIdentity", False),
]


def test_secrets_of_lines_equal_sql(spark, tmp_path):
    # Values of one part, of few letters, of digits, and one whose entropy is 3 only when rounded.
    even = "".join(c * 20 for c in "abcdef0") + "1" * 20
    near = even.replace("a" * 20, "a" * 21).replace("b" * 20, "b" * 19)
    values = ["0123456789abcdef0123", "a1" * 12, "1234567890" * 3, even, near, "abc", "0f" * 9 + "1"]
    text = "\n".join(f'say {name} = "{v}" and "{v}" twice' for v in values for name in ("api_token", "client_id", "colour"))
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, text), (2, ""), (3, None), (4, f'x\r\nthe_key = "{values[0]}"')], "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    rows = texts.QUERIES["prj14_secrets"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({texts.ORACLES['prj14_secrets']})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want) and len(want) == 16
    assert {r[4] for r in want} == {"credible", "trivial"}


def test_expressions_that_hold_the_caller(spark):
    assert judged(spark, CALLERS, scalars.reads_caller) == CALLERS


STATEMENTS = [
    ('CREATE INDEX "i" ON "bookings" ("creator_id")', "add-index", "bookings", "create-index-without-concurrently"), ("CREATE INDEX CONCURRENTLY i ON t (c)", "add-index", "t", "none"),
    ("create unique index i on a.t using btree (c)", "add-index", "t", "create-index-without-concurrently"), ('ALTER TABLE "invoices" ADD COLUMN "org" uuid NOT NULL DEFAULT 0', "add-column", "invoices", "add-not-null-with-default"),
    ("ALTER TABLE t ALTER COLUMN c TYPE bigint", "alter-type", "t", "type-rewrite"), ("ALTER TABLE t ALTER c SET DATA TYPE text", "alter-type", "t", "type-rewrite"), ("ALTER TABLE ONLY t ENABLE ROW LEVEL SECURITY", "enable-rls", "t", "none"),
    ("ALTER TABLE IF EXISTS only_t DISABLE ROW LEVEL SECURITY", "disable-rls", "only_t", "none"), ("CREATE POLICY p ON t FOR SELECT USING (true)", "create-policy", None, "none"), ("SELECT 1", "other", None, "none"),
    ("ALTER TABLE customers DROP COLUMN legacy_name", "drop-column", "customers", "none"), ("ALTER TABLE t ADD COLUMN a numeric(10, 2), DROP CONSTRAINT c", "drop-constraint", "t", "none"), ("ALTER TABLE t RENAME TO u", "rename", "t", "none"),
    ("ALTER TABLE t ADD PRIMARY KEY (id)", "add-constraint", "t", "none"), ("ALTER TABLE t ADD CHECK (a > 0)", "add-constraint", "t", "none"), ("ALTER TABLE t ADD IF NOT EXISTS a int", "add-column", "t", "none"),
    ("ALTER TABLE t ALTER COLUMN a SET NOT NULL", "alter-column", "t", "add-not-null-with-default"), ("CREATE TEMPORARY TABLE x (id int)", "create-table", "x", "none"), ("CREATE TABLE IF NOT EXISTS s.x(id int)", "create-table", "x", "none"),
    ("CREATE OR REPLACE MATERIALIZED VIEW v AS SELECT 1", "create-view", None, "none"), ("DROP TABLE IF EXISTS a", "drop-table", "a", "none"), ("DROP POLICY p ON t", "drop-policy", None, "none"), ("TRUNCATE logs;", "truncate", "logs", "none"),
    ("truncate table only logs", "truncate", "logs", "none"), ("REVOKE ALL ON t FROM r", "grant", None, "none"), ("UPDATE ONLY t SET a = 1", "backfill", "t", "none"), ("DELETE FROM t", "backfill", "t", "none"), ("INSERT INTO t(a) VALUES (1)", "backfill", "t", "none"),
]


def test_statements(spark):
    rows = spark.createDataFrame([(i, "f", s[0]) for i, s in enumerate(STATEMENTS)], "stmt_id int, file string, sql string")
    found = scalars.statements(rows).orderBy("stmt_id").collect()
    assert [(STATEMENTS[r["stmt_id"]][0], r["operation"], r["table"], r["lock"]) for r in found] == STATEMENTS


def test_version_gaps(spark):
    cases = [("1.2.3", "1.2.4", "patch"), ("1.2.3", "1.3.0", "minor"), ("1.2.3", "2.0.0", "major"), ("2.0.0", "1.9.9", "none"), ("1.0.0-rc.1", "1.0.0", "patch"), ("v1.2", "1.2.0", "none"), ("latest", "1.0.0", None), (None, "1.0.0", None)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert [r["g"] for r in rows.select("i", version_gap(F.col("a"), F.col("b")).alias("g")).orderBy("i").collect()] == [c[2] for c in cases]


EXPRESSIONS = [
    ("github.head_ref", True), ("github.event.issue.title", True), ("github.event.issue.number", False), ("github.event.pull_request.body", True), ("github.event.pull_request.number", False), ("github.event.pull_request.head.ref", True),
    ("github.event.pull_request.head.label", True), ("github.event.pull_request.head.sha", False), ("github.event.pull_request.head.repo.default_branch", True), ("github.event.comment.body", True), ("github.event.comment.id", False),
    ("github.event.review.body", True), ("github.event.review_comment.body", True), ("github.event.discussion.title", True), ("github.event.discussion.body", True), ("github.event.head_commit.message", True), ("toJSON(github.event.head_commit)", False),
    ("github.event.commits.0.message", True), ("github.event.workflow_run.head_branch", True), ("github.event.workflow_run.head_commit.message", True), ("github.event.workflow_run.id", False), ("github.event.pages.page_name", True),
    ("github.event.inputs.x", True), ("contains(github.event.comment.body, 'x')", True), ("inputs.x", False), ("github.sha", False), ("secrets.X", False),
]


def test_expressions_that_outsiders_write(spark):
    assert judged(spark, EXPRESSIONS, workflows.outsider_writes) == EXPRESSIONS


S = "${{ secrets.S }}"
PRINTED = [
    (f'echo "//npm/:_authToken={S}" >> .npmrc', False), (f'echo "token is {S}"', True), (f"echo {S} >&2", True), (f"echo {S} >> $GITHUB_STEP_SUMMARY", True), (f"echo {S} | base64", False), (f"echo {S} | tee log.txt", True),
    (f"echo {S} > /dev/null", False), (f'echo "a > {S}"', True), (f"echo {S} ; cat y > z", True), (f"echo {S} && cat y > z", True), (f"echo {S} || true", True), (f"curl -H {S}", False), (f"sudo printf '%s' {S}", True), (f"echoes {S}", False),
    (f"node -e 'console.log({S})'", False), (f"node -p console.log({S})", True), (f"echo {S} 2> err", False),
]


def test_whether_a_secret_is_printed(spark):
    at = lambda v: F.regexp_instr(v, F.lit(r"\$\{\{"))
    assert judged(spark, PRINTED, lambda v: workflows.printed(v, at(v))) == PRINTED


@pytest.mark.parametrize("event", workflows.UNTRUSTED_EVENTS)
def test_every_event_of_outsiders_makes_a_workflow_untrusted(spark, event):
    wf = spark.createDataFrame([("w", f"push,{event}", None, None, "n"), ("v", "push,pull_request", None, None, "n")], "workflow string, triggers string, permissions string, concurrency string, name string")
    assert {r["workflow"]: r["severity"] for r in workflows.permission_rules(wf).collect()} == {"w": "high", "v": "medium"}


def test_rules_one_by_one_equal_the_stacked_ones(spark):
    steps = [(1, "w", "deploy", "self-hosted", f"echo {S}\ncurl {S}\nrun ${{{{ github.head_ref }}}}", "${{ github.event.pull_request.head.sha }}"), (2, "w", "test", "ubuntu", "npm ci", None), (3, "v", "test", "Self-Hosted ,x", "npm ci", None)]
    steps = spark.createDataFrame(steps, "step_id int, workflow string, job string, runner string, script string, checkout_ref string")
    wf = spark.createDataFrame([("w", "pull_request_target", None, None, "CI"), ("v", "push", "contents:read", "g", "CI")], "workflow string, triggers string, permissions string, concurrency string, name string")
    uses = spark.createDataFrame([(1, "w", "deploy", "x/y@main", "DEPLOY_KEY", "acme"), (2, "w", "test", "actions/cache@v4", None, "acme"), (3, "v", "test", "x/y@v1", "SLACK_HOOK", None)], "use_id int, workflow string, job string, uses string, secret string, owner string")
    found = {tuple(r) for r in workflows.workflow_findings(steps, wf, uses).collect()}
    assert found == {
        ("target-checkout", "w", "1", "critical"), ("script-injection", "w", "1", "high"), ("secret-in-script", "w", "1", "high"), ("secret-in-script", "w", "1", "medium"), ("missing-concurrency", "w", "deploy", "medium"),
        ("self-hosted-runner", "w", "deploy", "high"), ("self-hosted-runner", "v", "test", "medium"), ("untrusted-trigger", "w", "trigger", "high"), ("permissions", "w", "undeclared", "high"), ("unpinned-action", "w", "1", "critical"),
        ("unpinned-action", "v", "3", "medium"), ("secret-to-action", "w", "1", "high"), ("secret-to-action", "v", "3", "medium"), ("unpinned-platform-action", "w", "platform-actions", "low"),
    }


def test_risk_of_units(spark):
    units = [
        (1, "route", {"method": "DELETE", "authenticated": "no", "authCheck": "none", "mutates": "true", "readsBody": "false", "validation": "none", "pagination": "none", "idParams": "customerId,id"}),
        (2, "route", {"method": "GET", "authenticated": "yes", "authCheck": "role", "mutates": "false", "validation": "schema", "pagination": "cursor", "idParams": "unknown"}),
        (3, "webhook", {}), (4, "migration", {"ordinal": "12", "lockRisk": "none", "destructive": "false", "hasDownMigration": "true"}), (5, "migration", {"ordinal": "none", "version": "0003_x", "lockRisk": "type-rewrite"}),
        (6, "data-access", {"operation": "update", "hasWhere": "false", "filtersByPrincipal": "scoped", "insideLoop": "false"}), (7, "container", {}), (8, "cron", {"authCheck": "none"}), (9, "sink", None),
    ]
    rows = spark.createDataFrame([(u, 1, k, "f", 1, a) for u, k, a in units], "unit_id int, run int, kind string, file string, line int, attributes map<string,string>")
    found = {r["unit_id"]: (r["risk"], r["reasons"]) for r in risk.risk_scores(rows).collect()}
    assert found[1] == (100, "kind.entry-point; auth.absent; write.any; auth.unchecked; input.object-id; input.unvalidated; write.delete")
    assert found[2] == (30, "kind.entry-point") and found[3] == (68, "kind.entry-point; signature.unproven; replay.unproven")
    assert found[4] == (12, "kind.applied; schema.recent") and found[5] == (20, "kind.applied; schema.locks; schema.recent")
    assert found[6] == (28, "kind.database; rows.all; rows.write") and found[7] == (4, "kind.delivery") and found[8] == (58, "kind.entry-point; auth.open-schedule") and found[9] == (24, "kind.sink")


def test_paths_that_are_equal_up_to_parameters(spark):
    segments = ("a", "b", ":x", "{y}", "[z]")
    paths = ["", "/", "/a?q=:x", "/a/b/", "//", *[f"/{p}/{q}" for p in segments for q in segments], *[f"/{p}/b/{q}/c" for p in segments for q in segments], "/a", "/:x", None]
    left = [(i % 40, p) for i, p in enumerate(paths)]
    right = [(100 + i, p) for i, p in enumerate(reversed(paths + paths[:9]))]
    cut = lambda p: ["*" if s[:1] in (":", "[", "{") else s for s in p.split("?")[0].rstrip("/").split("/")]
    same = lambda a, b: a is not None and b is not None and len(cut(a)) == len(cut(b)) and all("*" in (x, y) or x == y for x, y in zip(cut(a), cut(b), strict=True))
    want = sorted((i, j) for i, a in left for j, b in right if same(a, b))
    lhs, rhs = (spark.createDataFrame(rows, "id long, path string") for rows in (left, right))
    assert sorted(map(tuple, scalars.same_path_pairs(lhs, rhs).collect())) == want
    counts = scalars.same_path_counts(lhs, rhs)
    assert sorted(map(tuple, counts.collect())) == sorted((i, sum(x == i for x, _ in want), min(j for x, j in want if x == i)) for i in {x for x, _ in want})


def test_paths_are_counted_without_their_pairs(spark):
    # 2 x 30000 paths of one length, parameters in the first place: 900 million pairs.
    lhs = spark.range(30_000).selectExpr("id", "concat('/:any/', id % 3) AS path")
    rhs = spark.range(30_000).selectExpr("id", "concat('/', id % 1000, '/', CASE WHEN id % 2 = 0 THEN ':x' ELSE '1' END) AS path")
    got = scalars.same_path_counts(lhs, rhs)
    plan = got._jdf.queryExecution().executedPlan()
    assert {tuple(r) for r in got.groupBy(F.col("left_id") % 3, "n", "first").count().collect()} == {(0, 15_000, 0, 10_000), (1, 30_000, 0, 10_000), (2, 15_000, 0, 10_000)}
    assert "NestedLoop" not in plan.toString() and "Cartesian" not in plan.toString()
