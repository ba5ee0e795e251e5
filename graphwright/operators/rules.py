"""Rule tables: domains, libraries, architecture patterns, entry points, layers and texts.

Rules are small tables of fixed values; they are matched by Spark expressions or joins against the (large) features.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp
from ..model import Graph
from ..plans.containment import contained
from ..plans.settle import stored
from .structure import major_modules

#: Domain, feature, how it is matched, keys, weight. Denominator of a domain is the sum of its weights.
DOMAIN_SIGNALS = [
    ("computer_vision", "import", "contains", ["cv2"], 30),
    ("computer_vision", "import", "contains", ["pil"], 15),
    ("computer_vision", "import", "contains", ["imageio"], 15),
    ("computer_vision", "import", "contains", ["torchvision"], 25),
    ("computer_vision", "import", "contains", ["ultralytics"], 30),
    ("computer_vision", "import", "contains", ["segmentation_models"], 25),
    ("computer_vision", "path", "ends", [".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".gif"], 15),
    ("computer_vision", "function", "contains", ["videocapture", "camera", "webcam"], 20),
    ("backend_api", "import", "contains", ["flask"], 35),
    ("backend_api", "import", "contains", ["fastapi"], 35),
    ("backend_api", "import", "contains", ["express"], 35),
    ("backend_api", "import", "equals", ["spring", "springboot"], 35),
    ("backend_api", "import", "contains", ["django"], 35),
    ("backend_api", "decorator", "contains", ["route", "get", "post", "put", "delete"], 25),
    ("backend_api", "path", "contains", ["controller", "middleware"], 20),
    ("ml", "import", "contains", ["torch"], 30),
    ("ml", "import", "contains", ["tensorflow"], 30),
    ("ml", "import", "contains", ["sklearn"], 25),
    ("ml", "import", "contains", ["xgboost"], 25),
    ("frontend", "import", "contains", ["react"], 35),
    ("frontend", "import", "contains", ["vue"], 35),
    ("frontend", "import", "equals", ["angular", "@angular"], 35),
    ("frontend", "path", "ends", [".jsx", ".tsx", ".vue"], 30),
    ("cli", "import", "contains", ["click"], 35),
    ("cli", "import", "contains", ["typer"], 35),
    ("cli", "import", "contains", ["argparse"], 25),
    ("cli", "decorator", "contains", ["command"], 20),
    ("infrastructure", "path", "ends", [".tf"], 35),
    ("infrastructure", "path", "contains", ["dockerfile"], 35),
    ("infrastructure", "path", "contains", ["docker-compose"], 35),
    ("infrastructure", "path", "contains", ["k8s", "kubernetes", "pod.yaml", "deployment.yaml"], 35),
]

#: Patterns with their signals, in the order that breaks ties.
PATTERNS = [
    ("Microservice", ["docker", "kubernetes", "grpc", "protobuf"]),
    ("Event-Driven", ["celery", "kafka", "pika", "rabbitmq", "eventbus", "dispatcher", "listener"]),
    ("API-First", ["fastapi", "flask", "router", "endpoint", "route", "rest", "openapi"]),
    ("MVC", ["django", "models", "views", "templates", "controller"]),
    ("Pipeline", ["pipeline", "transform", "stage", "step", "processor", "chain", "airflow", "dask"]),
    ("Layered", ["service", "repository", "dao", "entity", "model", "controller", "handler"]),
    ("CLI", ["click", "typer", "argparse", "main", "cli", "command"]),
]

#: Entry file names and their kinds.
ENTRY_FILES = [
    ("main.py", "main"), ("app.py", "main"), ("manage.py", "cli"), ("server.py", "main"), ("run.py", "main"), ("cli.py", "cli"), ("index.js", "main"), ("index.ts", "main"),
    ("main.ts", "main"), ("worker.py", "worker"), ("tasks.py", "worker"), ("scheduler.py", "scheduler"),
]

#: Decorators of route handlers.
ROUTES = ["app.route", "router.get", "router.post", "router.put", "router.delete", "router.patch", "bp.route", "app.get", "app.post"]

#: Layers with their keywords, in order.
LAYERS = [
    ("API Layer", ["api", "routes", "router", "endpoints", "views", "controller"]),
    ("Business Logic", ["services", "service", "business", "logic", "core", "use_cases"]),
    ("Analysis Engine", ["parsers", "parser", "analyzer", "architect", "analysis"]),
    ("Graph Infrastructure", ["graph", "neo4j", "network", "topology"]),
    ("Data Models", ["models", "model", "schema", "schemas", "entities"]),
    ("Persistence Layer", ["database", "db", "repository", "dao", "storage"]),
    ("Auth & Security", ["auth", "security", "authentication", "authorization"]),
    ("Background Workers", ["workers", "worker", "tasks", "celery", "jobs", "queue"]),
    ("Frontend / UI", ["components", "pages", "ui", "views", "frontend", "client"]),
    ("Utilities", ["utils", "util", "helpers", "helper", "lib", "common", "shared"]),
    ("Configuration", ["config", "settings", "configuration", "env"]),
]

#: Key and category of libraries that imports point at.
LIBRARIES = [
    ("flask", "web_framework"), ("fastapi", "web_framework"), ("django", "web_framework"), ("starlette", "web_framework"), ("aiohttp", "web_framework"),
    ("numpy", "numeric"), ("pandas", "data"), ("sklearn", "ml"), ("torch", "deep_learning"), ("tensorflow", "deep_learning"), ("keras", "deep_learning"),
    ("transformers", "nlp"), ("openai", "llm"), ("langchain", "llm"), ("anthropic", "llm"), ("cv2", "vision"), ("pil", "vision"), ("face_recognition", "vision"),
    ("mediapipe", "vision"), ("ultralytics", "vision"), ("sqlalchemy", "database"), ("pymongo", "database"), ("redis", "cache"), ("neo4j", "graph_db"), ("psycopg2", "database"),
    ("sqlite3", "database"), ("boto3", "cloud"), ("celery", "async"), ("kafka", "messaging"), ("pika", "messaging"), ("jwt", "auth"), ("cryptography", "security"),
    ("bcrypt", "auth"), ("tree_sitter", "parsing"), ("ast", "parsing"), ("react", "ui_framework"), ("axios", "http"), ("pytest", "testing"), ("unittest", "testing"),
    ("pydantic", "validation"), ("airflow", "orchestration"), ("dask", "distributed"), ("web3", "blockchain"), ("pygame", "game"), ("click", "cli"), ("typer", "cli"),
    ("argparse", "cli"), ("rich", "cli"), ("stripe", "payments"), ("elasticsearch", "search"), ("selenium", "automation"), ("scrapy", "scraping"), ("bs4", "scraping"),
    ("yaml", "config"), ("dotenv", "config"), ("prometheus_client", "monitoring"), ("sentry_sdk", "monitoring"),
]

#: What a file is for, told by the layer that its path belongs to.
RESPONSIBILITIES = [("name", keys, f"belongs to {layer}") for layer, keys in LAYERS]


def _matches(text: Column, how: str, keys: list[str]) -> Column:
    hit = F.lit(False)
    for k in keys:
        hit = hit | (text.contains(k) if how == "contains" else F.endswith(text, F.lit(k)) if how == "ends" else F.startswith(text, F.lit(k)) if how == "starts" else text == k)
    return hit


def domain_scores(features: DataFrame, signals: list[tuple[str, str, str, list[str], int]] = DOMAIN_SIGNALS) -> DataFrame:
    """domain, score, max_score, confidence: one pass over features (kind, text), with one flag for each signal."""
    flags = features.agg(*(F.max((F.col("kind") == kind) & _matches(F.lower("text"), how, keys)).alias(f"s{i}") for i, (_, kind, how, keys, _) in enumerate(signals)))
    rows = F.array(*(F.struct(F.lit(d).alias("domain"), F.when(F.col(f"s{i}"), F.lit(w)).otherwise(0).cast("long").alias("got"), F.lit(w).cast("long").alias("w")) for i, (d, *_, w) in enumerate(signals)))
    scored = flags.select(F.explode(rows).alias("r")).select("r.*").groupBy("domain").agg(F.sum("got").alias("score"), F.sum("w").alias("max_score"))
    return scored.withColumn("confidence", F.least(F.lit(97), F.expr("score * 100 div max_score")).cast("long"))


def best_domain(scores: DataFrame) -> DataFrame:
    """The domain with the highest score (ties by name); below half of its maximum it is Unknown."""
    top = scores.orderBy(F.desc("score"), "domain").limit(1)
    known = F.col("confidence") >= 50
    return top.select(F.when(known, F.col("domain")).otherwise("Unknown").alias("domain"), F.when(known, F.col("confidence")).otherwise(0).alias("confidence"),
                      F.when(F.col("confidence") >= 70, "definite").when(known, "tentative").otherwise("uncertain").alias("language"))


def graph_features(g: Graph) -> DataFrame:
    """(kind, text): what domain rules look at; modules are distinct before they are matched."""
    imports = g.nodes("Import").select(F.lit("import").alias("kind"), F.col("module").alias("text")).distinct()
    paths = g.nodes("File").select(F.lit("path").alias("kind"), F.col("rel_path").alias("text"))
    functions = g.nodes("Function").select(F.lit("function").alias("kind"), F.col("name").alias("text"))
    decorators = g.nodes("Function").select(F.lit("decorator").alias("kind"), F.explode("decorators").alias("text")).distinct()
    return imports.unionByName(paths).unionByName(functions).unionByName(decorators).filter("text is not null")


def libraries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIBRARIES, "key string, category string")


def detect_libraries(imports: DataFrame, known: DataFrame, separator: str = "[._ ]") -> DataFrame:
    """(module, key): for each distinct module the longest known key that is the module or a prefix of it before a separator.

    Candidate prefixes are cut from the module at its separators and joined by equality, so no pair of module and key is tried in vain.
    """
    modules = imports.select(F.lower("module").alias("module")).filter("module is not null").distinct()
    ends = F.filter(F.sequence(F.lit(1), F.length("module")), lambda i: (i == F.length("module")) | F.regexp_like(F.substring(F.col("module"), i + 1, F.lit(1)), F.lit(separator)))
    tried = modules.select("module", F.explode(F.transform(ends, lambda i: F.substring(F.col("module"), F.lit(1), i))).alias("key"))
    found = tried.join(known.select(F.lower("key").alias("key")), "key")
    return found.groupBy("module").agg(F.max_by("key", F.length("key")).alias("key"))


def library_evidence(g: Graph, known: DataFrame, separator: str = "[._ ]") -> DataFrame:
    """key, files that import it, and the first three of their paths."""
    used = g.nodes("Import").select("file_id", F.lower("module").alias("module")).join(detect_libraries(g.nodes("Import"), known, separator), "module")
    paths = used.select("key", "file_id").distinct().join(g.nodes("File").select(F.col("id").alias("file_id"), "rel_path"), "file_id")
    ranked = paths.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("rel_path")))
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.col("rel_path")))), ",")
    return ranked.groupBy("key").agg(F.count(F.lit(1)).alias("files"), first.alias("evidence"))


def tokens(g: Graph) -> DataFrame:
    """token: modules, imported and own, and names of files and functions, that patterns are looked for in."""
    own = [g.nodes(label).select(F.col("name").alias("token")) for label in ("File", "Function")]
    found = g.nodes("Import").select(F.col("module").alias("token")).distinct().unionByName(major_modules(g).select(F.col("module_name").alias("token")))
    return found.unionByName(own[0]).unionByName(own[1])


def architecture_pattern(tokens: DataFrame, patterns: list[tuple[str, list[str]]] = PATTERNS) -> DataFrame:
    """pattern and score: how many of its signals occur in some token (column token)."""
    signals = sorted({s for _, keys in patterns for s in keys})
    flags = tokens.agg(*(F.max(F.lower("token").contains(s)).alias(f"s{i}") for i, s in enumerate(signals)))
    score = lambda keys: sum((F.coalesce(F.col(f"s{signals.index(k)}"), F.lit(False)).cast("long") for k in keys), F.lit(0).cast("long"))
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(p).alias("pattern"), score(keys).alias("score")) for i, (p, keys) in enumerate(patterns)))
    return flags.select(F.explode(rows).alias("r")).select("r.place", "r.pattern", "r.score")


def best_pattern(scores: DataFrame) -> DataFrame:
    top = scores.orderBy(F.desc("score"), "place").limit(1)
    return top.select(F.when(F.col("score") > 0, F.col("pattern")).otherwise("Layered").alias("pattern"), "score")


def entry_points(files: DataFrame, functions: DataFrame, names: list[tuple[str, str]] = ENTRY_FILES, routes: list[str] = ROUTES) -> DataFrame:
    """type, name, path: at most ten, entry files first, then the first function of at most three files with route handlers.

    files: rel_path; functions: name, file_path, decorators.
    """
    base = F.lower(F.element_at(F.split("rel_path", "/"), -1))
    kind = F.lit(None).cast("string")
    for name, k in reversed(names):
        kind = F.when(base == name, k).otherwise(kind)
    mains = files.select(F.lit(1).alias("part"), kind.alias("type"), base.alias("name"), F.col("rel_path").alias("path")).filter("type is not null").orderBy("path").limit(10)
    is_route = F.exists("decorators", lambda d: _matches(F.lower(d), "contains", routes))
    handlers = functions.filter(is_route).select(F.element_at(F.split("file_path", "/"), -1).alias("path"), "name").groupBy("path").agg(F.min("name").alias("name")).orderBy("path").limit(3)
    return mains.unionByName(handlers.select(F.lit(2).alias("part"), F.lit("route").alias("type"), "name", "path")).orderBy("part", "path").limit(10).drop("part")


def graph_entry_points(g: Graph, names: list[tuple[str, str]] = ENTRY_FILES, routes: list[str] = ROUTES) -> DataFrame:
    """entry_points of a graph's own files and functions."""
    owner = g.nodes("File").select(F.col("id").alias("file_id"), F.col("rel_path").alias("file_path"))
    return entry_points(g.nodes("File").filter("rel_path is not null"), g.nodes("Function").select("file_id", "name", "decorators").join(owner, "file_id"), names, routes)


def reading_guide(g: Graph, names: list[tuple[str, str]] = ENTRY_FILES, routes: list[str] = ROUTES, models: tuple[str, ...] = ("schema", "model")) -> DataFrame:
    """step, source, path: where to begin, at most five files, each once.

    First two entry files that are a main program, a command line or a worker; then of the three files that most depend on those not named yet (nor a file
    of the same name), to four in all; then the first file, by path, whose name holds a word of models. Steps are numbered without gaps.
    """
    from .structure import file_hotspots

    base = F.element_at(F.split("path", "/"), -1)
    by = lambda *order: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("place")  # noqa: E731  over few rows, each limited before
    entries = graph_entry_points(g, names, routes).filter(F.col("type").isin("main", "cli", "worker")).orderBy("path").limit(2).select("path")
    named = entries.agg(F.collect_list("path").alias("named"))
    top = file_hotspots(g).orderBy(F.desc("dependency_count"), "id").limit(3).select(F.col("name").alias("path"), F.struct(-F.col("dependency_count"), "id").alias("rank"))
    top = top.crossJoin(named).filter(~F.array_contains("named", F.col("path")) & ~F.array_contains("named", base))  # one row
    top = top.groupBy(base.alias("base")).agg(F.min_by("path", "rank").alias("path"), F.min("rank").alias("rank"), F.first("named").alias("named"))
    top = top.select("path", by("rank"), F.size("named").alias("n")).filter(F.col("place") + F.col("n") <= 4)
    before = entries.select(F.lit(1).alias("part"), by("path"), F.lit("entry").alias("source"), "path").unionByName(top.select(F.lit(2).alias("part"), "place", F.lit("central").alias("source"), "path"))
    seen = before.agg(F.flatten(F.collect_list(F.when(F.col("part") == 1, F.array("path")).otherwise(F.array(F.col("path"), base)))).alias("seen"))
    kept = g.nodes("File").select(F.col("rel_path").alias("path")).filter(_matches(F.lower(base), "contains", list(models)))
    first = kept.crossJoin(seen).filter(~F.array_contains("seen", F.col("path"))).orderBy("path").limit(1)  # one row joined
    every = before.unionByName(first.select(F.lit(3).alias("part"), F.lit(1).alias("place"), F.lit("model").alias("source"), "path"))
    return every.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("part", "place")).alias("step"), "source", "path")


def layers(g: Graph, rules: list[tuple[str, list[str]]] = LAYERS, files: int = 3, components: int = 4, keep: int = 6) -> DataFrame:
    """layer and components: module names, then at most three file names, that hold one of a layer's keywords."""
    modules = major_modules(g).select(F.lit(0).alias("part"), F.col("module_name").alias("item"), F.lower("module_name").alias("text"))
    paths = g.nodes("File").filter("rel_path is not null").select(F.lit(1).alias("part"), F.element_at(F.split("rel_path", "/"), -1).alias("item"), F.lower("rel_path").alias("text"))
    hit = F.filter(F.array(*(F.when(_matches(F.col("text"), "contains", keys), F.struct(F.lit(i).alias("place"), F.lit(name).alias("layer"))) for i, (name, keys) in enumerate(rules))), lambda x: x.isNotNull())
    found = modules.unionByName(paths).select("part", "item", F.explode(hit).alias("l")).select("l.place", "l.layer", "part", "item").distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("place", "part").orderBy("item"))).filter((F.col("part") == 0) | (F.col("rank") <= files))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "item"))), lambda x: x["item"])
    return ranked.groupBy("place", "layer").agg(F.array_join(F.slice(ordered, 1, components), ",").alias("components")).orderBy("place").limit(keep).drop("place")


def module_roles(g: Graph, roles: dict[str, str] | None = None) -> DataFrame:
    """Major modules with a role: that which roles has for the lower-cased name, else the layer whose words hold the name, else the name itself."""
    roles = roles if roles is not None else {k: layer for layer, keys in reversed(LAYERS) for k in keys}
    role = F.concat(F.lit("code about "), F.col("module_name"))
    for name, text in roles.items():
        role = F.when(F.lower("module_name") == name, text).otherwise(role)
    return major_modules(g).select("module_name", role.alias("role"))


def responsibilities(g: Graph, rules: list[tuple[str, list[str], str]] = RESPONSIBILITIES) -> DataFrame:
    """What each file is for: the first rule that its name, then one of its functions' names, matches."""
    hits = [F.max(_matches(F.lower("name"), "contains", keys)).alias(f"r{i}") for i, (kind, keys, _) in enumerate(rules) if kind == "function"]
    own = g.nodes("Function").groupBy(F.col("file_id").alias("owner")).agg(F.count(F.lit(1)).alias("functions"), *hits)
    joined = g.nodes("File").join(own, F.col("id") == F.col("owner"), "left")
    text = F.lit("holds core logic")
    for i, (kind, keys, says) in reversed(list(enumerate(rules))):
        text = F.when(_matches(F.lower("name"), "contains", keys) if kind == "name" else F.coalesce(F.col(f"r{i}"), F.lit(False)), says).otherwise(text)
    return joined.select("id", text.alias("responsibility"))


def start_here(g: Graph, keep: int = 6) -> DataFrame:
    """Where to begin: top files by dependents, then the first file that names a schema or model; without repeats."""
    from .structure import file_hotspots

    top = file_hotspots(g).orderBy(F.desc("dependency_count"), "id").limit(3).select(F.lit(2).alias("part"), "name")
    models = g.nodes("File").filter(_matches(F.lower("rel_path"), "contains", ["schema", "model"])).orderBy("rel_path").limit(1).select(F.lit(3).alias("part"), F.col("rel_path").alias("name"))
    return top.unionByName(models).groupBy("name").agg(F.min("part").alias("part")).orderBy("part", "name").limit(keep)


def onboarding_minutes(g: Graph) -> DataFrame:
    """5 to read, 3 for each of at most 8 modules (two more than found), 2 for each 20 files, at most 10; within 10 to 90."""
    one = major_modules(g).agg(F.count(F.lit(1)).alias("modules")).crossJoin(g.nodes("File").agg(F.count(F.lit(1)).alias("files")))  # one row each
    minutes = 5 + 3 * F.least(F.lit(8), F.col("modules") + 2) + 2 * F.least(F.lit(10), F.expr("files div 20"))
    return one.select(clamp(minutes, 10, 90).cast("long").alias("minutes"))


#: Topic, name and clauses of observations. A clause is kind and words of a signal, the least number that it must have, and whether it is wanted or must be missing.
OBSERVATIONS = [
    ("decision", "stored as a graph, in no relational database", [("library", "equals", ["graph_db"], 1, True), ("library", "equals", ["database"], 1, False)]),
    ("decision", "reading is kept apart from services", [("module", "contains", ["parser"], 1, True), ("module", "contains", ["service"], 1, True)]),
    ("decision", "work is handed to queues", [("library", "equals", ["async", "messaging"], 1, True)]),
    ("decision", "data are checked against schemas", [("library", "equals", ["validation"], 1, True)]),
    ("decision", "offered over HTTP", [("library", "equals", ["web_framework"], 1, True)]),
    ("observation", "parts depend on each other in a circle", [("cycle", "contains", [""], 1, True)]),
    ("observation", "much depends on one file", [("dependents", "contains", [""], 6, True)]),
    ("observation", "functions without classes", [("count", "equals", ["functions"], 16, True), ("count", "equals", ["classes"], 1, False)]),
    ("observation", "few classes for many functions", [("count", "equals", ["functions for a class"], 16, True), ("count", "equals", ["classes"], 1, True)]),
    ("observation", "reading, graph and services are three stages", [("module", "contains", ["parser"], 1, True), ("module", "contains", ["graph"], 1, True), ("module", "contains", ["service"], 1, True)]),
    ("observation", "offered over HTTP and on the command line", [("entry", "equals", ["route"], 1, True), ("entry", "equals", ["cli"], 1, True)]),
    ("observation", "no file says what it is about", [("path", "starts", ["readme"], 1, False)]),
]


def signals(g: Graph, known: DataFrame, names: list[tuple[str, str]] = ENTRY_FILES, routes: list[str] = ROUTES) -> DataFrame:
    """kind, text, path, n: what observations are made from. known: key, category of libraries.

    library: category and a file that imports one; module: name and files; entry: type and path; path: each file's; cycle: a node and its length;
    dependents: the file that most depend on; count: functions, classes, and functions for a class, rounded up.
    """
    from .structure import closed_trails, file_hotspots

    text = lambda kind, what, path, n: [F.lit(kind).alias("kind"), what.alias("text"), path.alias("path"), n.cast("long").alias("n")]
    one, col = F.lit(1), F.col
    files = g.nodes("File").filter("rel_path is not null")
    imports = g.nodes("Import").select("file_id", F.lower("module").alias("module")).join(detect_libraries(g.nodes("Import"), known), "module")
    category = known.select(F.lower("key").alias("key"), "category").distinct()
    used = imports.join(category, "key").select("category", "file_id").distinct().join(files.select(col("id").alias("file_id"), "rel_path"), "file_id")
    total = g.nodes("Function", "Class").agg(F.count_if(col("label") == "Function").alias("f"), F.count_if(col("label") == "Class").alias("c"))
    counts = F.array(*(F.struct(F.lit(name).alias("text"), n.cast("long").alias("n")) for name, n in (("functions", col("f")), ("classes", col("c")), ("functions for a class", F.ceil(col("f") / F.greatest(col("c"), one))))))
    parts = [
        used.select(*text("library", col("category"), col("rel_path"), one)),
        major_modules(g).select(*text("module", col("module_name"), col("module_name"), col("file_count"))),
        graph_entry_points(g, names, routes).select(*text("entry", col("type"), col("path"), one)),
        files.select(*text("path", col("rel_path"), col("rel_path"), one)),
        closed_trails(g).select(*text("cycle", col("node"), col("node"), col("cycle_length"))),
        file_hotspots(g).orderBy(F.desc("dependency_count"), "id").limit(1).select(*text("dependents", col("name"), col("name"), col("dependency_count"))),
        total.select(F.explode(counts).alias("x")).select(*text("count", col("x.text"), F.lit(None).cast("string"), col("x.n"))),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def observations(found: DataFrame, rules: list[tuple[str, str, list[tuple[str, str, list[str], int, bool]]]] = OBSERVATIONS) -> DataFrame:
    """topic, rule, n, evidence: rules of which every wanted clause has a signal and no other one has; how many paths its wanted clauses have, and the first three. found: signals().

    One pass over the signals, each with the clauses that it meets; a path is counted once for a rule, signals without a path are not.
    """
    clauses = sorted({(kind, how, tuple(keys), least) for _, _, parts in rules for kind, how, keys, least, _ in parts})
    meets = [F.when((F.col("kind") == kind) & _matches(F.lower("text"), how, list(keys)) & (F.col("n") >= least), F.lit(i)) for i, (kind, how, keys, least) in enumerate(clauses)]
    met = stored(found.select("path", F.explode(F.array_compact(F.array(*meets))).alias("clause")).distinct())  # read five times below
    place = {c: i for i, c in enumerate(clauses)}
    parts = [(r, place[kind, how, tuple(keys), least], wanted) for r, (_, _, rows) in enumerate(rules) for kind, how, keys, least, wanted in rows]
    spark = found.sparkSession
    asked = spark.createDataFrame(parts, "place int, clause int, wanted boolean")
    names = spark.createDataFrame([(i, topic, name) for i, (topic, name, _) in enumerate(rules)], "place int, topic string, rule string")
    has = met.select("clause").distinct().withColumn("has", F.lit(True))
    holds = asked.join(has, "clause", "left").groupBy("place").agg(F.every(F.coalesce("has", F.lit(False)) == F.col("wanted")).alias("holds")).filter("holds").select("place")
    paths = met.filter("path is not null").join(asked.filter("wanted"), "clause").join(holds, "place").select("place", "path").distinct()
    many = paths.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    few = paths.withColumn("nth", F.row_number().over(Window.partitionBy("place").orderBy("path"))).filter("nth <= 3")
    few = few.groupBy("place").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("evidence"))
    out = holds.join(names, "place").join(many, "place", "left").join(few, "place", "left")
    return out.select("topic", "rule", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("evidence", F.lit("")).alias("evidence"))


def relative_paths(paths: DataFrame, known: DataFrame) -> DataFrame:
    """path, relative: the relative path known for it, as it is or with forward slashes; else, if it holds a known path, the same with that replaced and
    without slashes before it; else, for temporary folders, what follows them; else the path with forward slashes. No path gives the empty text.

    paths: path; known: path, rel_path. Of several known paths that one holds the longest counts (ties: the last as text), of several relative paths the least.
    """
    slashes = lambda c: F.regexp_replace(c, r"\\", "/")
    known = known.filter("path <> ''").groupBy("path").agg(F.coalesce(F.min("rel_path"), F.lit("")).alias("rel_path"))
    asked = paths.select("path").filter("path <> ''").distinct().withColumn("plain", slashes("path"))
    exact = lambda on: known.select(F.col("path").alias(on), F.col("rel_path").alias(f"of_{on}"))
    asked = asked.join(exact("path"), "path", "left").join(exact("plain"), "plain", "left").withColumn("known", F.coalesce("of_path", "of_plain"))
    whole = known.groupBy(slashes("path").alias("part")).agg(F.min("rel_path").alias("rel_path"))
    inner = contained(asked.filter("known is null").select(F.col("plain").alias("text")), whole).groupBy("text").agg(F.max(F.struct(F.length("part").alias("n"), "part"))["part"].alias("part"))
    inner = inner.join(whole, "part").select(F.col("text").alias("plain"), F.ltrim(F.replace("text", F.col("part"), F.col("rel_path")), F.lit("/")).alias("inner"))
    plain = F.col("plain")
    temporary = F.regexp_like(plain, F.lit("/var/folders/|/tmp/|/private/var/"))
    inside = F.when(plain.contains("/T/"), F.regexp_replace(plain, r"(?s)^.*?/T/(?:[^/]*/)?", "")).otherwise(F.element_at(F.split(plain, "/"), -1))
    found = asked.join(inner, "plain", "left").select(F.col("path").alias("asked"), F.coalesce("known", "inner", F.when(temporary, inside).otherwise(plain)).alias("relative"))
    return paths.select("path").join(found, F.col("path") == F.col("asked"), "left").select("path", F.coalesce("relative", F.lit("")).alias("relative"))
