from __future__ import annotations

import random
import re
import tempfile

from kilnspark.operators import assembly, declarations
from kilnspark.sources.assembled import PIECES
from kilnspark.streaming import requests as stream


def plain(language, text):
    """What each pattern finds, with lines counted from the start of the text."""
    out = []
    known = language if language in declarations.LANGUAGES else declarations.OTHER
    for d in declarations.DECLARATIONS:
        if d.language != known:
            continue
        for m in re.finditer(d.pattern, text, re.ASCII):
            name = next(m[g] for g in d.names if m[g])
            parts = [p.strip() for p in ((m[d.detail] or "") if d.detail else "").split(",") if p.strip()]
            if (d.language, d.kind) == ("python", "function"):
                parts = [re.split("[:=]", p)[0].strip() for p in parts if p not in ("self", "cls")]
            for n in name.split(",") if d.kind == "import" else [name]:
                out.append((d.kind, n.strip(), ",".join(parts), text.count("\n", 0, m.start()) + 1))
    return sorted(out)


def test_declarations_of_mixed_texts(spark):
    rng, rows = random.Random(8), []
    for i in range(60):
        language = rng.choice([*PIECES, "typescript", "Python ", None])
        pieces = PIECES.get((language or "go").strip().lower().replace("typescript", "javascript"), PIECES["go"])
        rows.append((i, language, "".join(rng.choice(pieces).replace("{p}", str(rng.randrange(99))).replace("{q}", str(j)) for j in range(rng.randrange(30)))))
    rows += [(100, "python", None), (101, "java", ""), (102, "python", "\x01def f(\n    a,\n  b: int = 3):\n  pass\n\n\nimport a.b , c\n"), (103, "", "function f (x)\n" * 3)]
    df = spark.createDataFrame(rows, "path long, language string, content string")
    got = {}
    for r in declarations.declarations(df).collect():
        got.setdefault(r.path, []).append((r.kind, r.name, r.detail, r.line))
    for path, language, text in rows:
        assert sorted(got.get(path, [])) == plain((language or "unknown").strip().lower(), (text or "").replace("\x01", "")), (path, text)
    assert declarations.declarations(df.limit(0)).collect() == []


WORDS = [f"w{i} " for i in range(200)]


def test_shuffled_and_doubled_chunks_give_the_text(spark):
    rng = random.Random(9)
    chunks = [(1, i, w) for i, w in enumerate(WORDS)] * 2 + [(2, i, w) for i, w in enumerate(WORDS[:20]) if i != 7] + [(3, 1, "x")] + [(4, 0, None), (4, 1, "y"), (None, 0, "z"), (4, None, "z")]
    rng.shuffle(chunks)
    df = spark.createDataFrame(chunks, "stream long, seq long, token string")
    got = {r.stream: tuple(r)[1:] for r in assembly.assembled(df).collect()}
    assert got == {1: ("".join(WORDS), 200, 200, 200, 0), 2: ("".join(WORDS[:7]), 19, 0, 7, 12), 3: ("", 1, 0, 0, 1), 4: ("y", 2, 0, 2, 0)}
    where = tempfile.mkdtemp(prefix="spark-tokens-")
    for i in range(0, len(chunks), 60):
        part = spark.createDataFrame(chunks[i : i + 60], df.schema).selectExpr("*", "timestamp'2024-01-01 10:00:00' AS ts")
        part.coalesce(1).write.mode("append").parquet(f"{where}/in")
        if i % 180 == 0 or i + 60 >= len(chunks):  # the stream is started anew
            source = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
            stream.token_text(source).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/check").trigger(availableNow=True).start().awaitTermination()
    said = {}
    for r in spark.read.parquet(f"{where}/out").orderBy("first_seq").collect():
        text, repeats = said.get(r.stream, ("", 0))
        said[r.stream] = (text + r.text, repeats + r.repeats)
    assert said == {1: ("".join(WORDS), 200), 2: ("".join(WORDS[:7]), 0), 3: ("", 0), 4: ("y", 0)}
