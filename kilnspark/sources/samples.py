"""Small sources that set off rules and just miss them, and a corpus made of them.

The driver's tables hold no program code. Each part stands for a file whose content is
one of these samples with the part's key written into it, so a corpus of code grows
with the table and SQL can spell the very same texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension and text of each sample; {id} becomes the part's key.
SAMPLES: list[tuple[str, str]] = [
    ("py", '''"""Orders of shop {id}."""
import os
import re
from models.order import Order, Line


class Store:
    """Keeps orders."""

    def __init__(self, url):
        self.db = Database(url)

    def load(self, ids):
        # one query for each id
        out = []
        for i in ids:
            out.append(self.db.query(i))
        return out

    def total(self, orders, tax=[]):
        result = 0
        for o in orders:
            for line in o.lines:
                result += line.price if line.price > 0 and line.count > 0 else 0
        return result
'''),
    ("py", '''def report_{id}(rows, list, use_cache, mode, a, b):
    text = ""
    for r in rows:
        text += "row"
        rows.sort()
        pat = re.compile("x")
    for i in range(len(rows)):
        print(rows[i])
    if rows in [1, 2]:
        return 4711
    return text
    rows = 5
'''),
    ("py", '''import time
import requests


async def poll_{id}(url: str) -> None:
    time.sleep(1)
    requests.get(url)


async def calm(url: str) -> None:
    await asyncio.sleep(1)


def cube(n: int) -> int:
    total = 0
    for i in n:
        for j in n:
            while j:
                total += d[i] + d[j] + d[0]
    try:
        total = eval(str(total))
    except:
        pass
    return total
'''),
    ("py", '''password = "hunter22{id}"
safe = get_password()
cursor.execute(f"select {x}")
os.system(cmd)
subprocess.run(["ls"], shell=False)
pickle.loads(blob)
yaml.load(f)
yaml.safe_load(f)
hashlib.md5(b)
hashlib.sha256(b)
host = "10.0.0.1"
random.choice(xs)
DEBUG = True
requests.get(url)
assert user.role
assert x > 0
tempfile.mktemp()
retrieval(x)
# TODO: tidy {id}
'''),
    ("py", '''def broken_{id}(:
    return 1
'''),
    ("py", '''def walk_{id}(node, depth):
    if node is None:
        return 0
    elif depth > 9:
        return 1
    else:
        for child in node:
            if child:
                with open(child) as f:
                    while f:
                        walk_{id}(child, depth)
    pick = lambda x: x
    keys = [k for k in node if k]
    return a and b or c


class Base:
    def one(self) -> int:
        return 1


class Leaf(Base):
    def two(self) -> int:
        return 2
'''),
    ("js", '''// list of shop {id}
import React from "react";
var count = 0;
for (const item of items) {
    const el = document.querySelector(".row");
    el.innerHTML = item;
    label = label + "x";
    JSON.parse(item);
}
/* block
   comment */
const done = items.filter(x => x.ok).map(x => x.id);
if (count == 1) {
    console.log("one");
}
setInterval(tick, 1000);
'''),
    ("js", '''const apiKey = "abcdef{id}";
let query = db.run(`select ${name}`);
window.addEventListener("scroll", draw);
eval(code);
evaluate(code);
Math.random();
localStorage.setItem("token", t);
fetch(url);
child_process.exec(cmd);
const x: any = 1;
const y: any = 2;
alert("hi");
const t = setInterval(tick, 9);
clearInterval(t);
const xhr = new XMLHttpRequest();
if (a === 1) { b(); } else if (a === 2) { c(); } else if (a === 3) { d(); } else if (a === 4) { e(); }
'''),
    ("", '''#!/usr/bin/env python3.11
value = {id}
'''),
    ("py", '''start = {id}
def first():
    a = load(1)
    b = load(2)
    c = a + b
    d = c * 2
    e = d - a
    f = e / b
    return f
def second():
    A = load(1)  # again
    b = load(2)
    c = a + b
    d = c * 2

    e = d - a
    f = e / b
    return f
def first():
    a = load(1)
    b = load(2)
    c = a + b
    d = c * 2
    e = d - a
    f = e / b
    return f
'''),
]
#: A file of routes; {id} becomes its number.
ROUTES = '''@router.get("/items/{id}")
async def read_item(item):
    return item


@app.post( '/items' )
def add_item(item):
    return item


@app.route("/shop/{id}", methods=["GET", 'POST'])
def shop():
    return "shop"


@blueprint.route("/plain")
def plain():
    return "plain"


@router.delete("/lost")
'''
#: A script of functions; {id} becomes its number.
SCRIPT = '''async function load(url, tries) {
  if (url && tries) {
    for (const x of tries) {
      retry(x);
    }
  }
  return url || "{id}";
}

const sum_{id} = (a, b) => {
  return a + b;
};
const open_one = async (x) => {
'''
LANGUAGES = {"py": "python", "js": "javascript", "": "unknown"}
#: Texts that one task makes.
TEXTS_A_TASK = 20_000


def _dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Keys of a small table dealt to all cores before texts are made of them: a text is much larger than its key.

    A task has so many texts at most, so that tasks do not grow with the table and a slow core takes fewer of them.
    """
    keys = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    return keys.repartition(max(spark.sparkContext.defaultParallelism, -(-keys.count() // TEXTS_A_TASK)))


def code_files(spark: SparkSession, sf_dir: str, extension: str | None = None) -> DataFrame:
    """path, content, language, project, sample: one file for each part; only those of an extension if it is given."""
    pick = (F.col("p_partkey") % len(SAMPLES)).cast("int")
    each = lambda values: F.element_at(F.array(*map(F.lit, values)), pick + 1)
    ext, key = each([e for e, _ in SAMPLES]), F.col("p_partkey").cast("string")
    project = F.concat(F.lit("shop"), F.col("p_size").cast("string"))
    path = F.concat(F.lit("src/"), project, F.lit("/mod"), key, F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    rows = _dealt(spark, sf_dir, "part", "p_partkey", "p_size").select(path.alias("path"), F.replace(each([t for _, t in SAMPLES]), F.lit("{id}"), key).alias("content"), each([LANGUAGES[e] for e, _ in SAMPLES]).alias("language"), project.alias("project"), pick.alias("sample"), ext.alias("ext"))
    return (rows if extension is None else rows.where(F.col("ext") == extension)).drop("ext")


def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: one file of routes for each supplier."""
    key = F.col("s_suppkey").cast("string")
    return _dealt(spark, sf_dir, "supplier", "s_suppkey").select(F.concat(F.lit("routes/shop"), key, F.lit(".py")).alias("path"), F.replace(F.lit(ROUTES), F.lit("{id}"), key).alias("content"))


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: one script for each supplier."""
    key = F.col("s_suppkey").cast("string")
    return _dealt(spark, sf_dir, "supplier", "s_suppkey").select(F.concat(F.lit("web/shop"), key, F.lit(".js")).alias("path"), F.replace(F.lit(SCRIPT), F.lit("{id}"), key).alias("content"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same relation in SQL, as the table expression `code`.
CODE_SQL = f"""code AS (
  SELECT 'src/shop' || p_size || '/mod' || p_partkey || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS path, replace(body, '{{id}}', p_partkey::VARCHAR) AS content, language, 'shop' || p_size AS project, sample, ext, p_partkey AS key
  FROM part JOIN (VALUES {", ".join(f"({i}, {_sql(e)}, {_sql(t)}, {_sql(LANGUAGES[e])})" for i, (e, t) in enumerate(SAMPLES))}) s(sample, ext, body, language) ON p_partkey % {len(SAMPLES)} = sample)"""


def expected_sql(columns: str, rows: list[tuple]) -> str:
    """What is known of each sample as SQL rows of every file made of it: sample first, then the columns; {id} becomes the part's key."""
    value = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else _sql(x)
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [c.split()[1] for c in columns.split(", ")]
    out = ", ".join(f"replace(e.{n}, '{{id}}', key::VARCHAR) AS {n}" if k == "VARCHAR" else f"e.{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True))
    return f"WITH {CODE_SQL} SELECT path, {out} FROM code JOIN (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) e(sample, {', '.join(names)}) USING (sample)"
