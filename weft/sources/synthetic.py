"""Made-up portfolios of any size, for benchmarks: a row for each file, made where it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAINS = ("order", "payment", "invoice", "customer", "shipment", "stock", "refund", "catalog", "review", "coupon", "session", "ticket")
TEAMS = 5


def _made(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def portfolio(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(rel_path, suffix, content) of n projects in twelve domains and four languages. Three of four projects
    share their domain's topic and table; the fourth has its own."""
    rows = spark.range(n).withColumn("h", F.xxhash64(F.lit(seed), "id"))
    domain = F.get(F.array(*[F.lit(d) for d in DOMAINS]), F.pmod("h", F.lit(len(DOMAINS))).cast("int"))
    own = F.pmod(F.shiftright("h", 8), F.lit(4)) == 0
    return of_projects(rows.select(
        F.format_string("%s-%05d", domain, F.col("id")).alias("dir"), _made("team-", F.pmod(F.shiftright("h", 16), F.lit(TEAMS)).cast("string")).alias("owner"), "id", F.pmod(F.shiftright("h", 24), F.lit(4)).alias("language"),
        F.when(own, _made(domain, ".private.", F.col("id").cast("string"))).otherwise(_made(domain, ".created")).alias("topic"),
        F.when(own, _made(domain, "_", F.col("id").cast("string"))).otherwise(_made(domain, "s")).alias("table"), _made("staging_", domain).alias("staging"),
    ))


def of_projects(rows: DataFrame) -> DataFrame:
    """(rel_path, suffix, content) of projects (dir, owner or null, id, language, topic, table, staging): language 0 is Python, 1 Java,
    2 JavaScript, 3 SQL. All but SQL send to the topic; all but JavaScript name the table."""
    name, topic, table, id_ = F.col("dir"), F.col("topic"), F.col("table"), F.col("id").cast("string")
    file = lambda path, text: F.struct(_made(name, "/", path).alias("rel_path"), F.lit("." + path.rsplit(".", 1)[-1] if "." in path else "").alias("suffix"), text.alias("content"))
    owner = file("OWNER", _made(F.col("owner"), "\n"))
    python = F.array(
        owner, file("requirements.txt", F.lit("kafka-python\nrequests\n")),
        file("app.py", _made("from kafka import KafkaProducer\nimport store\nTOPIC = '", topic, "'\n\ndef run(p, cur, x):\n    p.send(TOPIC, x)\n    cur.execute('INSERT INTO ", table, " (id, total) VALUES (1, 2)')\n    return ", id_, "\n")),
        file("store.py", _made("def load(cur):\n    cur.execute('SELECT * FROM ", table, "')\n    return ", id_, "\n")),
    )
    java = F.array(
        owner, file("pom.xml", F.lit("<project><dependency><groupId>org.springframework.kafka</groupId><artifactId>spring-kafka</artifactId></dependency></project>")),
        file("Main.java", _made('package p;\nclass Main {\n  static final String TOPIC = "', topic, '";\n  void run() { kafka.send(TOPIC, ', id_, '); }\n  @Query("SELECT x FROM ', table, '") void q();\n}\n')),
    )
    node = F.array(owner, file("package.json", F.lit('{"dependencies": {"kafkajs": "^2.0.0", "axios": "^1.0.0"}}')), file("index.js", _made("const TOPIC = '", topic, "';\nproducer.send({ topic: TOPIC, messages: [", id_, "] });\n")))
    sql = F.array(owner, file("schema.sql", _made("CREATE TABLE ", table, " (id BIGINT, total DOUBLE);\n")), file("load.sql", _made("INSERT INTO ", table, " (id, total) SELECT id, total FROM ", F.col("staging"), ";\n")))
    language = F.col("language")
    return rows.select(F.inline(F.when(language == 0, python).when(language == 1, java).when(language == 2, node).otherwise(sql))).filter("content is not null")
