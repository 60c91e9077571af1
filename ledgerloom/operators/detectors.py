"""Stack facts: signals of packages and of paths joined with what a repository declares and holds.

A signal names a key (a package, a file's name, a folder, an ending) and the fact that it stands for.
Manifests and paths are turned into keys, so that any number of signals costs one equi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scales import CONFIDENCES, label_of
from ledgerloom.operators.facts import with_first
from ledgerloom.sources.samples import PATHS, one_of
from ledgerloom.sources.views import table

# What well-known packages, file names, folders and endings tell of a stack, by kind of fact.
PACKAGES = {
    "framework": ("express", "fastify", "hono", "koa", "next", "nestjs"), "data-layer": ("drizzle-orm", "knex", "kysely", "mongoose", "prisma", "sequelize", "typeorm"), "auth": ("lucia", "next-auth", "passport"),
    "frontend": ("react", "svelte", "vue"), "queue": ("amqplib", "bullmq", "kafkajs"), "scheduler": ("agenda", "cron", "node-cron"), "config-validation": ("envalid", "zod"),
}
NAMES = {
    "package-manager": {"package-lock.json": "npm", "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "bun.lockb": "bun"}, "container": {"dockerfile": "docker", "docker-compose.yml": "compose"},
    "serverless": {"vercel.json": "vercel", "serverless.yml": "serverless", "wrangler.toml": "workers", "template.yaml": "sam"}, "env-file": {".env": "env", ".env.example": "env-example"},
}
FOLDERS = {"migrations": {"migrations": "sql-migrations", "drizzle": "drizzle-migrations"}, "ci": {"workflows": "github-actions", ".circleci": "circleci"}, "router": {"app": "app-router", "pages": "pages-router"}, "iac": {"terraform": "terraform", "helm": "helm"}}
ENDINGS = {"iac": {"tf": "terraform"}, "data-layer": {"prisma": "prisma"}, "frontend": {"vue": "vue", "svelte": "svelte"}}
SECTIONS = {"dependencies": 0, "peerDependencies": 1, "devDependencies": 1}
EVIDENCE = 25


def signals(spark: SparkSession) -> DataFrame:
    """(how, key, kind, value, conf) of all tables above; conf is a place in the scale of confidences."""
    rows = [("package", p, kind, p, 0) for kind, names in PACKAGES.items() for p in names]
    for how, tables, conf in (("name", NAMES, 0), ("folder", FOLDERS, 1), ("ending", ENDINGS, 1)):
        rows += [(how, key, kind, value, conf) for kind, known in tables.items() for key, value in known.items()]
    return spark.createDataFrame(rows, "how string, key string, kind string, value string, conf int")


def facts_from(keys: DataFrame, signals_: DataFrame, limit: int = EVIDENCE) -> DataFrame:
    """(run, kind, value, confidence, places, evidence): a fact for each value that a key tells of, with its strongest confidence and first places.

    keys has run, how, key, file and weak, a step down in confidence. Keys that several signals name give
    several facts; places are counted once each.
    """
    hit = keys.join(signals_, ["how", "key"]).withColumn("conf", F.least(F.col("conf") + F.col("weak"), F.lit(len(CONFIDENCES) - 1)))
    each = hit.groupBy("run", "kind", "value", "file").agg(F.min("conf").alias("conf"))
    got = each.groupBy("run", "kind", "value").agg(F.min("conf").alias("conf"), F.count("*").alias("places"))
    got = with_first(got, each, ["run", "kind", "value"], ["conf", "file"], "file", limit, "evidence")
    return got.select("run", "kind", "value", label_of(F.col("conf"), CONFIDENCES).alias("confidence"), "places", "evidence")


def manifest_keys(manifests: DataFrame) -> DataFrame:
    """Keys of declared packages: manifests has run, file, section and package; unknown sections don't count."""
    weak = F.lit(None).cast("int")
    for section, step in SECTIONS.items():
        weak = F.when(F.col("section") == section, step).otherwise(weak)
    return manifests.select("run", F.lit("package").alias("how"), F.lower("package").alias("key"), "file", weak.alias("weak")).where("weak is not null")


def path_keys(paths: DataFrame, foreign: Column | None = None) -> DataFrame:
    """Keys of files: the name, every folder above it and the ending, in lower case; foreign files have none."""
    low = F.lower(F.regexp_replace("file", r"\\", "/"))
    parts = F.filter(F.split(low, "/"), lambda p: (p != "") & (p != "."))
    rows = paths.withColumn("__p", parts).where("size(__p) > 0 and not array_contains(__p, 'node_modules')")
    name = F.element_at("__p", -1)
    ending = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))
    key = lambda how, value: F.struct(F.lit(how).alias("how"), value.alias("key"))
    folders = F.transform(F.array_distinct(F.slice("__p", F.lit(1), F.size("__p") - 1)), lambda f: key("folder", f))
    keys = F.concat(folders, F.array(key("name", name), key("ending", ending)))
    return rows.select("run", "file", F.inline(keys)).where("key is not null").select("run", "how", "key", "file", F.lit(0).alias("weak"))


def deepest_cover(imports: DataFrame, least: float = 0.5) -> DataFrame:
    """(run, name, folder, files): the deepest folder that holds at least a share of the files that import a name.

    imports has run, name and file. Files are counted for every folder above them by one explode and one
    sum; of equally deep folders the fuller one, then the first by text is taken.
    """
    rows = imports.select("run", "name", "file").distinct().withColumn("p", F.split("file", "/"))
    up = rows.select("run", "name", F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("p", F.lit(1), k), "/").alias("folder")))).alias("f"))
    counted = up.groupBy("run", "name", "f.depth", "f.folder").agg(F.count("*").alias("files"))
    total = rows.groupBy("run", "name").agg(F.count("*").alias("total"))
    cover = counted.join(total, ["run", "name"]).where(F.col("files") >= F.col("total") * least)
    best = F.struct((-F.col("depth")).alias("a"), (-F.col("files")).alias("b"), "folder")
    return cover.groupBy("run", "name").agg(F.min(best).alias("m")).select("run", "name", F.col("m.folder").alias("folder"), (-F.col("m.b")).alias("files"))


_PACKAGES = tuple(p for names in PACKAGES.values() for p in names) + ("left-pad", "Express", "lodash")
_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optional")
_FILES = PATHS + ("Dockerfile", "infra/main.tf", ".github/workflows/ci.yml", "pnpm-lock.yaml", "api/wrangler.toml", "Helm/app/values.yaml", "prisma/schema.prisma", ".env", "web\\pages\\x.vue")


def _pick(values, divisor):
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("p_partkey") / divisor) % len(values)).cast("int") + 1)


def _manifests(s, d):
    return table(s, d, "part").select((F.col("p_partkey") % 20).alias("run"), F.concat(F.lit("packages/p"), F.col("p_partkey") % 7, F.lit("/package.json")).alias("file"), _pick(_SECTIONS, 3).alias("section"), _pick(_PACKAGES, 1).alias("package"))


def _paths(s, d):
    return table(s, d, "part").select((F.col("p_partkey") % 20).alias("run"), _pick(_FILES, 1).alias("file"))


QUERIES = {
    "det09_dependency_facts": lambda s, d: facts_from(manifest_keys(_manifests(s, d)), signals(s)),
    "det07_path_facts": lambda s, d: facts_from(path_keys(_paths(s, d)), signals(s)),
    "det02_import_cover": lambda s, d: deepest_cover(_paths(s, d).where("file like '%/%'").select("run", F.element_at(F.split("file", r"\."), -1).alias("name"), "file")),
}
_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_SIG = "SELECT * FROM (VALUES " + ", ".join(
    [f"('package', '{p}', '{k}', '{p}', 0)" for k, names in PACKAGES.items() for p in names]
    + [f"('{how}', '{key}', '{kind}', '{v}', {c})" for how, tables, c in (("name", NAMES, 0), ("folder", FOLDERS, 1), ("ending", ENDINGS, 1)) for kind, known in tables.items() for key, v in known.items()]
) + ") t(how, \"key\", kind, \"value\", conf)"
_FACTS = """SELECT run, kind, "value", ['high', 'medium', 'low'][min(conf) + 1] AS confidence, count(*) AS places, array_to_string(list(file ORDER BY conf, file)[1:25], ',') AS evidence FROM
 (SELECT run, kind, "value", file, min(least(conf + weak, 2)) AS conf FROM keys JOIN sig ON sig.how = keys.how AND sig."key" = keys."key" GROUP BY ALL) GROUP BY run, kind, "value\""""
_PATHS_SQL = f"SELECT p_partkey % 20 AS run, {_list(_FILES)}[p_partkey % {len(_FILES)} + 1] AS file FROM part"
ORACLES = {
    "det09_dependency_facts": f"""WITH sig AS ({_SIG}), keys AS (SELECT run, 'package' AS how, lower(package) AS "key", file, CASE section WHEN 'dependencies' THEN 0 ELSE 1 END AS weak FROM
 (SELECT p_partkey % 20 AS run, 'packages/p' || p_partkey % 7 || '/package.json' AS file, {_list(_SECTIONS)}[(p_partkey // 3) % {len(_SECTIONS)} + 1] AS section, {_list(_PACKAGES)}[p_partkey % {len(_PACKAGES)} + 1] AS package FROM part) WHERE section IN {one_of(SECTIONS)}) {_FACTS}""",
    "det07_path_facts": f"""WITH sig AS ({_SIG}), f AS (SELECT DISTINCT run, file, list_filter(string_split(replace(lower(file), chr(92), '/'), '/'), lambda p: p NOT IN ('', '.')) AS p FROM ({_PATHS_SQL})), ok AS (SELECT * FROM f WHERE len(p) > 0 AND NOT list_contains(p, 'node_modules')),
 keys AS (SELECT run, file, 'folder' AS how, unnest(p[:len(p) - 1]) AS "key", 0 AS weak FROM ok UNION ALL SELECT run, file, 'name', p[-1], 0 FROM ok UNION ALL SELECT run, file, 'ending', string_split(p[-1], '.')[-1], 0 FROM ok WHERE contains(p[-1], '.')) {_FACTS}""",
    "det02_import_cover": f"""WITH i AS (SELECT DISTINCT run, string_split(file, '.')[-1] AS name, file, string_split(file, '/') AS p FROM ({_PATHS_SQL}) WHERE file LIKE '%/%'),
 u AS (SELECT run, name, k AS depth, coalesce(array_to_string(p[1:k], '/'), '') AS folder FROM (SELECT *, unnest(range(0, len(p))) AS k FROM i)), c AS (SELECT run, name, depth, folder, count(*) AS files FROM u GROUP BY ALL), t AS (SELECT run, name, count(*) AS total FROM i GROUP BY ALL)
 SELECT run, name, folder, files FROM c JOIN t USING (run, name) WHERE files >= total * 0.5 QUALIFY row_number() OVER (PARTITION BY run, name ORDER BY depth DESC, files DESC, folder) = 1""",
}
