"""Raw texts that the audit operators judge, as views over the part table.

The driver's tables hold no paths, statements or reports, so the queries take them from here. Each view
is one projection in SQL that Spark and DuckDB both read, but for the way of picking from a list; operators and their SQL twins see the rows
only, never the rule by which a row was picked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.views import table


# A list and a place in it, in the words of each engine.
_SPARK = (("⟦", "element_at(array("), ("⟧⟨", "), CAST("), ("⟩", " + 1 AS INT))"))
_DUCK = (("⟦", "(["), ("⟧⟨", "])["), ("⟩", " + 1]"))


def pick(divisor: int, values: tuple) -> str:
    """One of the values by the part's number over a divisor; None stands for null."""
    place = f"CAST(floor(p_partkey / {divisor}) AS BIGINT) % {len(values)}"
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "⟦" + ", ".join(map(show, values)) + f"⟧⟨{place}⟩"


def _in(words: tuple, sql: str) -> str:
    for mark, word in words:
        sql = sql.replace(mark, word)
    return sql


PATHS = (
    "src/server/users.ts", "src/server/users.test.ts", "./SRC/Api/orders.spec.tsx", "app/(shop)/cart/[id]/page.tsx", "src/app/api/items/route.ts",
    "pages/blog/index.tsx", "pages/api/[...slug].js", "db/migrations/0001_init.sql", "db/migrations/0002_more.ts", "drizzle/0003_x.sql", "db/migrations/index.ts",
    "node_modules/left/index.js", ".next/server/app.js", "packages/a/dist/out.js", "README.md", "docs/guide.rst", "docs-api/intro.txt", ".env.example",
    "src/types.d.ts", "src/gen/api.generated.ts", "src/__fixtures__/user.ts", "src/__mocks__/fs.js", "web/mocks/handlers.ts", "tests/e2e/login.ts",
    "cypress/run.js", "scripts/test-server.mjs", "src/ui/button.stories.tsx", "src/components/Card.vue", "src/services/mail.ts", "lib/server/auth.server.ts",
    "features/list.ts", "/abs/etc/passwd", "../outside.ts", "a/../../b.ts", "`src/quoted.ts`", "file://src/x.ts", "src/deep/../flat.ts", "",
)
STATEMENTS = (
    "CREATE TABLE public.Orders (id int)", "create  unique index concurrently idx on orders (owner_id)", "CREATE INDEX i2 ON items USING btree (a, b)",
    "ALTER TABLE orders ADD COLUMN total int NOT NULL DEFAULT 0", "ALTER TABLE orders ADD COLUMN note text", "ALTER TABLE orders DROP COLUMN note", "DROP TABLE IF EXISTS old_orders",
    "ALTER TABLE orders ALTER COLUMN total TYPE bigint", "ALTER TABLE orders ALTER COLUMN total SET NOT NULL", "ALTER TABLE orders RENAME COLUMN a TO b",
    "ALTER TABLE t ENABLE ROW LEVEL SECURITY", "ALTER TABLE t DISABLE ROW LEVEL SECURITY", "ALTER TABLE t DROP CONSTRAINT c1", "ALTER TABLE t ADD CONSTRAINT c1 CHECK (a > 0)",
    "ALTER TABLE t ALTER COLUMN a SET DEFAULT 1", "TRUNCATE TABLE logs;", "GRANT SELECT ON orders TO reader", "INSERT INTO notes (a) VALUES (2)",
    "UPDATE orders SET total = 1 WHERE Owner_Id = 4 AND status IN (1, 2) ORDER BY id", "DELETE FROM orders WHERE o.created < 5 OR o.created > 9 LIMIT 3",
    "SELECT * FROM orders WHERE tenant_id = 1", "SELECT o.* FROM orders o", "SELECT DISTINCT a FROM items WHERE name LIKE 1 GROUP BY a", "WITH x AS (SELECT 1) SELECT a FROM x",
    "CREATE OR REPLACE VIEW v AS SELECT 1", "CREATE EXTENSION pg", "CREATE TYPE mood AS ENUM (1)", "DROP INDEX idx", "CREATE POLICY p ON orders FOR SELECT", "VACUUM", "",
)

# The columns of each view, as SQL over part.
SAMPLES = {
    "path": {"path_id": "p_partkey", "path": pick(1, PATHS), "source": pick(5, ("import a", "  use strict", "use client only", ""))},
    "statement": {"stmt_id": "p_partkey", "file": "concat('m/', CAST(CAST(floor(p_partkey / 9) AS BIGINT) AS STRING))", "sql": pick(1, STATEMENTS)},
    "grade": {
        "grade_id": "p_partkey", "scale": pick(1, ("sarif", "trivy", "lint", "audit")),
        "raw": pick(4, (" High ", "CRITICAL", "moderate", "warning", "error", "note", "none", "style", "unknown", "low", "Ignore", "??", "", None, "info", "medium")),
        "cvss": f"CAST({pick(3, (None, 0.0, 0.1, 3.9, 4.0, 6.9, 7.0, 8.9, 9.0, 10.0, -1.0))} AS DOUBLE)",
    },
    "match": {
        "match_id": "p_partkey",
        "rule_id": pick(1, ("generic-api-key", "aws-access-token", "private-key", "rsa-private-key", "jwt", "stripe-token", "gcp-key", "", "unknown-rule", "pkcs12-file", "vault-batch")),
        "name": pick(3, ("clientId", "client_secret", "API-KEY", "db.password", "colour", None, " ", "publicKey", "accessKeyIdSecret", "orgId", "refresh_token")),
        "value": pick(2, (
            "q8Zr2LmT0vXy5Wb9", "changeme", "<token-here>", "123456789012", "aaaaaaaaaaaaaa", "eyJhbGciOi", "your-api-key", "abcd...", "K3y_9fQ2mZx81LpR", "short", "",
            "the-token", "Ex-Am-Ple", "eyJhbGci.eyJzdWIi.c2ln", None, "{{ secret }}", "zX4!pW7@mN2#qR9c", "  q8Zr2LmT0vXy5Wb9; ",
        )),
        "context": pick(7, ("assignment", "reference", "documentation", "template", "unknown")),
        "reused": "p_partkey % 13 = 0",
    },
    "finding": {
        "seq": "p_partkey", "domain": pick(1, ("appsec", "dependencies", "data", "delivery")),
        "rule": pick(1, ("appsec.hardcoded-secret", "dependencies.vulnerable-package", "data.raw-query", "delivery.root-user")),
        "severity": pick(3, ("low", "medium", "high", "info", "critical")), "confidence": pick(2, ("high", "medium", "low")),
        "file": pick(16, ("src/server/users.ts", "src/server/users.test.ts", "Dockerfile", "README.md", "web/mocks/handlers.ts", ".env.example", "node_modules/left/index.js")),
        "line": "CAST(CAST(floor(p_partkey / 2) AS BIGINT) % 6 + 1 AS INT)", "symbol": pick(8, ("a", "b")), "source": pick(5, ("gitleaks", "opengrep", "rules")),
        "source_kind": pick(5, ("tool", "tool", "rule")),
        "snippet": pick(11, ("x = 1", None)), "stop": pick(6, (7, None)), "exploitability": pick(7, ("reachable", None)),
        "title": pick(1, ("Cloud provider credential in source", "CVE-2024-12345 in left@1.0.0", "cve in lower case", "CVE-2021-0001 and more", "Key material", "CVE-2024-99 is short")),
        "description": pick(4, ("short", "somewhat longer", "longest of the three here")), "recommendation": pick(9, ("fix", "fix it now")),
        "evidence": pick(3, ("", "e1", "e1;e2", "e2;e3;e4")), "criteria": pick(2, ("c1", "c1;c2", "")), "cwe": pick(2, ("", "CWE-321", "CWE-798;CWE-89")), "owasp": pick(7, ("", "A01;A02")),
    },
    "provenance": {
        "stmt_id": "p_partkey", "severity": pick(1, ("critical", "high", "medium", "low", "info")), "klass": pick(5, ("closed", "config", "unresolved", "reachable")),
        "context": pick(2, ("migration-up", "migration-down", "request-handler", "unknown")),
    },
    "version": {
        "pair_id": "p_partkey", "current": pick(1, ("1.2.3", "v2.0", "3", "1.2.3-rc.1", "latest", "10.0.1", "1.2", " 2.1.0 ", "0.9.9-beta", "2.0.0+b7")),
        "latest": pick(3, ("1.2.4", "2.0.0", "1.3.0", "1.2.3", "nightly", "10.0.0", "1.2.3-rc.2", "3.1")),
        "declared": pick(2, ("^1.2.0", "~1.2", ">=2.0.0 <3", "npm:@s/left@1.4.0", "*", "<2", "1.x", "x", "1.0.0 || 2.0.0", "workspace:*", "")),
        "listed": pick(7, ("1.2.4, 2.0.1", "2.0.1,1.2.9,10.0.2", "3.0.0", "", "bad, worse", "1.2.3, oops, 4.0.0")),
    },
    "uses": {
        "use_id": "p_partkey", "workflow": "concat('w', CAST(p_partkey % 40 AS STRING))", "job": pick(40, ("build", "deploy", "test")),
        "uses": pick(1, (
            "actions/checkout@v4", "actions/cache@0123456789abcdef0123456789abcdef01234567", "Acme/tool/sub@v1.2.3", "other/thing@main", "other/thing@v2", "github/codeql-action/init@v3.1.0",
            "acme/flow/.github/workflows/x.yml@v1", "docker://alpine:3.20", "docker://alpine@sha256:ab", "./local", "noat/action", "plain@v1", " third/party@1.0.0-beta.1 ",
        )),
        "secret": pick(3, (None, "GITHUB_TOKEN", "SLACK_HOOK", "DEPLOY_KEY")), "owner": pick(11, ("acme", None)),
    },
    "image": {"image_id": "p_partkey", "image": pick(1, ("node", "node:latest", "node:20", "node:20.11.1-slim", "reg.io:5000/team/app", "reg.io:5000/team/app:1.2.3", "node:20@sha256:ab", "debian:bookworm", "img:v1.2"))},
    "filter": {
        "filter_id": "p_partkey", "columns": pick(1, ("owner_id,name", "id", "created_by", "ticketId,age", "name", "user.email,tenantId", "userEmail", "item_uuid", "", "orgs", "accountSlug", "userName")),
        "value_text": pick(5, ("1", "session.user.id", "row.total", "auth()", "req.user", "tenantId", "jwt.sub", "")),
    },
    "workflow": {
        "workflow": "concat('w', CAST(p_partkey AS STRING))", "triggers": pick(1, ("push", "pull_request_target", "issue_comment,push", "workflow_run", "schedule", "fork", "watch,push")),
        "permissions": pick(3, (None, "write-all", "contents:read", "contents:write,id-token:write", "")), "concurrency": pick(2, (None, "deploy-group")), "name": pick(4, ("CI", "Release", "deploy prod")),
    },
    "run_step": {
        "step_id": "p_partkey", "workflow": "concat('w', CAST(p_partkey % 40 AS STRING))", "job": pick(40, ("build", "deploy", "test")), "runner": pick(3, ("ubuntu-latest", "self-hosted", "linux,self-hosted")),
        "script": pick(1, (
            "npm ci", "echo ${{ github.event.issue.title }}", "echo ${{ secrets.TOKEN }}", "deploy --key ${{ secrets.DEPLOY_KEY }}", "git fetch ${{ github.head_ref }}", "run ${{ env.SEG }} or ${{ env.NONE }}",
            "cat ${{ github.event.comment.body }} ${{ github.event.comment.body }}", "printf ok; echo done", "", "run ${{ github.event.inputs.x }}", "echo ${{ github.event.head_commit.message }}",
            "log ${{ toJSON(github.event.head_commit) }} ${{ github.event.issue.number }}", 'echo "//reg/:_t=${{ secrets.PAT }}" >> .npmrc', "echo ${{ secrets.A }} | base64", "echo ${{ secrets.A }} | tee out; curl x > y",
            "print ${{ secrets.B }} >> $GITHUB_STEP_SUMMARY", "printf ${{ secrets.B }} >&2 && echo x > y", 'echo "a > ${{ secrets.C }} b"', "${{ github.event.pages.page_name }} ${{ github.event.workflow_run.head_branch }}",
        )),
        "checkout_ref": pick(7, (None, "${{ github.event.pull_request.head.sha }}", "main")), "segment": pick(2, ("north", "south")),
    },
    "reply": {
        "reply_id": "p_partkey", "batch": "CAST(floor(p_partkey / 10) AS BIGINT)", "unit_id": "p_partkey % 7", "kind": pick(3, ("route", "sink")),
        "rule": pick(1, ("appsec.missing-auth", "appsec.open-redirect", "made.up", "data.raw-query", "appsec.missing-auth")),
        "severity": pick(2, ("critical", "high", "medium", "low", "info")), "file": pick(4, ("src/a.ts", "src/b.ts")), "line": "CAST(p_partkey % 50 AS INT)",
        "title": pick(5, ("short", "a title that is rather longer than the limit allows")), "echoed": pick(10, (0, 1, 2, 3)),
    },
    "error": {
        "error_id": "p_partkey",
        "text": pick(1, ("Usage limit reached", "request timed out", "ETIMEDOUT", "the model refused", "declined to respond", "max_output_tokens hit", "socket hang up", "your credit balance is low", "deadline exceeded", "confusal", "")),
        "note": pick(3, ("drop it", "Medium (miscounted)", "informational only", "critical!", "highly odd", "low, then high", "")), "seconds": pick(2, (5, 59, 60, 61, 120, 3725)),
        "cost": pick(4, (30, 300, 301, 900)), "uses_ai": "p_partkey % 3 = 0", "tool": "p_partkey % 5 <> 0",
    },
    "source": {
        "text_id": "p_partkey",
        "code": pick(1, (
            "if (req.headers.get(CRON_SECRET)) run()", "verifySignature(body)", "x-api-key", "Bearer abc", "const MY_SECRET_V2 = 1", "await auth()", "plain work", "queue.add(job, { jobId: 4, attempts: 3 })",
            "dedupeKey: x", "{ concurrency: 5, retries: 2 }", "uses secrets.NPM_TOKEN and secrets.AWS_KEY and secrets.NPM_TOKEN", "`tpl`", "`open", "public.`Users`;", "orders.owner_id lacks an index", "see config.json now",
        )),
        "tags": pick(3, ("rule:appsec.x,kind:sink", "kind: ,kind:route", "other", "", "rulex:1,rule:b")),
        "permissions": pick(5, ("contents:read,actions:write", "", "id-token:write")), "count": "p_partkey * p_partkey * 37", "kind": pick(7, ("route", "cron", "sink", "migration")),
        "definition": pick(2, ("id uuid PRIMARY KEY", "email varchar(20) NOT NULL UNIQUE", "total numeric(10, 2) DEFAULT 0", "owner_id int REFERENCES users (uid)", "at timestamp with time zone NOT NULL", "lonely", "team int REFERENCES teams")),
    },
    "advisory": {
        "seq": "p_partkey", "report": "p_partkey % 4", "target": pick(1, ("package-lock.json", "api/package-lock.json")), "cve": "concat('CVE-2024-', CAST(1000 + p_partkey AS STRING))",
        "package": "concat('pkg', CAST(p_partkey % 23 AS STRING))", "installed": pick(3, ("1.2.3", "2.0.0", None)), "fixed": pick(2, ("1.2.4, 2.0.1", "3.0.0", None, "")),
        "severity": pick(5, ("CRITICAL", "high", "UNKNOWN", None)), "nvd": f"CAST({pick(2, (9.8, None, 5.0))} AS DOUBLE)", "ghsa": f"CAST({pick(3, (7.5, None))} AS DOUBLE)",
        "path": pick(13, (None, "vendor/lock.json")),
    },
    "declared": {"report": "p_partkey % 4", "target": pick(1, ("package-lock.json", "api/package-lock.json")), "package": "concat('pkg', CAST(p_partkey % 23 AS STRING))", "section": pick(3, ("runtime", "dev", "other", "other"))},
    "component": {
        "seq": "p_partkey", "report": "p_partkey % 5", "type": pick(1, ("library", "library", "application")), "scope": pick(2, (None, "@org")), "name": "concat('lib', CAST(p_partkey % 31 AS STRING))",
        "version": pick(3, ("1.0.0", "2.1.0", None)), "license": pick(4, ("MIT", "GPL-3.0-only", "AGPL-3.0", "LGPL-2.1", "MIT OR GPL-2.0", None, "")),
    },
    "location": {"report": "p_partkey % 5", "package": "concat('lib', CAST(p_partkey % 29 AS STRING), '@', '1.0.0')", "file": pick(5, ("package-lock.json", "api/package-lock.json")), "line": "CAST(p_partkey AS INT)"},
    "misconfiguration": {
        "seq": "p_partkey", "report": "p_partkey % 4", "target": pick(1, ("Dockerfile", "main.tf", "k8s.yaml")), "type": pick(1, ("dockerfile", "terraform", "kubernetes")),
        "check": "concat('DS', CAST(p_partkey % 19 AS STRING))", "title": pick(3, ("root user", None)), "severity": pick(2, ("HIGH", "LOW", None)), "status": pick(5, ("FAIL", None, "PASS", "fail")),
        "resource": pick(4, (None, "bucket.a")), "line": pick(7, (None, 3, 0, 12)),
    },
}


def sample(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{_in(_SPARK, sql)} AS `{column}`" for column, sql in SAMPLES[name].items()])


def sample_sql(name: str) -> str:
    return "SELECT " + ", ".join(f'{_in(_DUCK, sql)} AS "{column}"' for column, sql in SAMPLES[name].items()) + " FROM part"


def over(body: str, *names: str, **more: str) -> str:
    """A DuckDB statement over the named views, as s_name, and further common table expressions."""
    parts = [f"s_{n} AS ({sample_sql(n)})" for n in names] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def matches(column: str, pattern: str) -> str:
    """DuckDB's test of a pattern on a column."""
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({column}, '{quoted}')"


def one_of(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
