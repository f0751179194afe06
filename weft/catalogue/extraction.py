"""Extraction from pages and documents, and a small portfolio written here, which tests read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.catalogue.standins import read
from weft.functions.text import stem
from weft.sources import files, webpages

SQL = (
    "INSERT INTO daily (day, total) SELECT o.day, sum(x) FROM orders o JOIN items i ON i.oid = o.id",
    "CREATE TABLE IF NOT EXISTS Items (id BIGINT PRIMARY KEY, price DECIMAL(10, 2) CHECK (price > 0), oid BIGINT REFERENCES orders(id), CONSTRAINT u UNIQUE (id, oid));",
    "CREATE TABLE orders (id BIGINT, customer BIGINT, FOREIGN KEY (customer) REFERENCES customers (id)); CREATE TABLE customers (id BIGINT, name TEXT);",
    "UPDATE customers SET name = 'x' WHERE id IN (SELECT id FROM gone); DELETE FROM gone",
    'CREATE VIEW "Best" AS SELECT * FROM daily',
    "CREATE TABLE audit (at TIMESTAMP, what TEXT);",
    "",
)
OPENAPI = '{"openapi": "3.0.0", "paths": {"/orders": {"get": {}, "post": {}, "parameters": []}, "/orders/{id}": {"delete": {"x": 1}}}}'
PACKAGE = '{"name": "shop", "description": "Sells things to people.", "dependencies": {"kafkajs": "^2.2.4", "@scope/ui": "~1.0.0"}, "devDependencies": {"jest": ">=29.0.0"}}'
POM = "<project><groupId>own</groupId>\n<artifactId>shop</artifactId><dependencies><dependency><groupId>org.springframework.kafka</groupId> <artifactId>spring-kafka</artifactId></dependency></dependencies></project>"
INVENTORY = '{"groups": [{"id": 1, "full_path": "a", "projects": [{"id": 10, "path_with_namespace": "a/x", "http_url_to_repo": "u1"}], "subgroups": [{"id": 2, "full_path": "a/b", "projects": [{"id": 11, "path_with_namespace": "a/b/y", "http_url_to_repo": "u2", "name": "why"}, {"id": 10, "name": "ex"}]}]}], "projects": [{"id": 12, "path_with_namespace": "z", "http_url_to_repo": ""}]}'


def html_links(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.inline(webpages.addresses(F.col("html")))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("address").alias("n_addresses"), F.min("address").alias("first"))


def url_parts(spark, sf):
    url = F.col("url")
    return read(spark, sf, "pages").select("page_id", F.parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("QUERY")).alias("query"))


def stems(spark, sf):
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("w")
    return read(spark, sf, "documents").select(words).distinct().select(stem(F.col("w")).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


#: A portfolio of our own: the shapes that the extractors must read.
PORTFOLIO = {
    "shop/OWNER": "team-shop\n",
    "shop/orders-py/requirements.txt": "kafka-python\nrequests>=2\n",
    "shop/orders-py/app.py": "import requests\nfrom kafka import KafkaProducer\nfrom store import save\nTOPIC = 'order.created'\nproducer = KafkaProducer()\n\ndef place(cur, o):\n    cur.execute('INSERT INTO orders (id, total) VALUES (%s, %s)', o)\n    producer.send(TOPIC, o)\n    producer.send(pick(o), o)\n    requests.get('http://stock/count')\n",
    "shop/orders-py/store.py": "def save(cur):\n    cur.execute('SELECT * FROM customers JOIN orders ON 1 = 1')\n",
    "shop/orders-py/openapi.json": OPENAPI,
    "shop/orders-copy/requirements.txt": "kafka-python\n",
    "shop/orders-copy/app.py": "import requests\nfrom kafka import KafkaProducer\nfrom store import save\nTOPIC = 'order.created'\nproducer = KafkaProducer()\n\ndef place(cur, o):\n    cur.execute('INSERT INTO orders (id, total) VALUES (%s, %s)', o)\n    producer.send(TOPIC, o)\n    producer.send(pick(o), o)\n    requests.get('http://stock/count')\n    # the same again\n",
    "bill/OWNER": "team-bill\n",
    "bill/billing/pom.xml": POM,
    "bill/billing/application.yml": "kafka:\n  topic:\n    order: order.created\n",
    "bill/billing/src/Billing.java": 'package bill;\nimport bill.Ledger;\nclass Billing {\n  @Value("${kafka.topic.order:none}") private String topic;\n  static final String LATE = "bill.late";\n  void run() { kafka.send(topic, 1); kafka.send(LATE, 2); }\n  @Query("SELECT c FROM customers c") List all();\n  @KafkaListener(topics = {"order.created"}) void on(String s) {}\n}\n',
    "bill/billing/src/Ledger.java": "package bill;\nclass Ledger { }\n",
    "web/package.json": PACKAGE,
    "web/index.js": "const { Kafka } = require('kafkajs');\nconst api = require('./api');\nconst TOPIC = 'order.created';\nproducer.send({ topic: TOPIC, messages: [] });\nconsumer.subscribe({ topics: ['bill.late'] });\nfetch('http://shop/orders');\n",
    "web/api.js": "export function call() { return axios.post('http://shop/place'); }\n",
    "data/warehouse/schema.sql": SQL[1] + "\n" + SQL[2] + "\n" + SQL[5] + "\n",
    "data/warehouse/load.sql": SQL[0] + ";\n",
    "node_modules/x/index.js": "fetch('http://no');\n",
}


def portfolio_files(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(p).alias("rel_path"), F.lit(c).alias("content")) for p, c in PORTFOLIO.items()])
    return spark.range(1).select(F.inline(rows)).filter(~files.is_ignored(F.col("rel_path"))).select("rel_path", files.suffix(F.col("rel_path")).alias("suffix"), "content")


QUERIES = {f.__name__: f for f in (html_links, url_parts, stems)}


ORACLES = {
    "html_links": r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x FROM pages), a AS (
        SELECT page_id, unnest(regexp_extract_all(x, '(?i)(?:action|<c:url\s+[^>]*value)\s*=\s*["'']([^"''#]+)["'']', 1)) AS u FROM l
        UNION ALL SELECT page_id, unnest(regexp_extract_all(x, '(?i)href\s*=\s*["''](/[^"''#]+)["'']', 1)) FROM l
        UNION ALL SELECT page_id, unnest(regexp_extract_all(x, '(?i)(?:fetch|axios\.(?:get|post|put|delete))\s*\(\s*[''"]([^''"]+)[''"]', 1)) FROM l),
        k AS (SELECT page_id, trim(u) AS u FROM a WHERE trim(u) <> '' AND NOT starts_with(trim(u), 'javascript:') AND NOT starts_with(trim(u), '${'))
        SELECT page_id, count(*) AS n, count(DISTINCT u) AS n_addresses, min(u) AS first FROM k GROUP BY page_id""",
    "url_parts": "SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages",
    "stems": "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT regexp_replace(w, '(?:ing|ers|er|ed|s)$', '') AS stem, count(*) AS n FROM w GROUP BY 1",
}
