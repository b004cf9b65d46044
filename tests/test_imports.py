from __future__ import annotations

from kilnspark.operators import imports

PYTHON = {
    "main.py": "import os, helpers\nfrom app.user import User\n",
    "helpers.py": "from app import order as o\nimport numpy as np\n",
    "app/__init__.py": "",
    "app/user.py": "from .order import Order\nfrom ..helpers import h\n",
    "app/order.py": "from . import user\n",
}
JS = {
    "src/a.js": "import x from './b';\nconst y = require('../lib/c')\nimport('./d/')\nimport z from 'react'; export { q } from '@org/pkg/sub'",
    "src/b.ts": "",
    "lib/c/index.js": "",
}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()) + [("empty", None)], "path string, content string")


def test_python_modules_resolve(spark):
    files = frame(spark, PYTHON)
    got = {(r.path, r.module): r.target for r in imports.resolve_python(imports.python_imports(files), files).collect()}
    assert got[("main.py", "helpers")] == "helpers.py" and got[("main.py", "os")] is None
    assert got[("main.py", "app.user")] == "app/user.py" and got[("helpers.py", "app")] == "app/__init__.py"
    assert got[("app/user.py", ".order")] == "app/order.py" and got[("app/user.py", "..helpers")] == "helpers.py"
    assert got[("app/order.py", ".")] == "app/__init__.py"


def test_js_modules_resolve(spark):
    files = frame(spark, JS)
    resolved = imports.resolve_js(imports.js_imports(files), files)
    got = {r.module: r.target for r in resolved.collect()}
    assert got == {"./b": "src/b.ts", "../lib/c": "lib/c/index.js", "./d/": None, "react": None, "@org/pkg/sub": None}
    assert imports.external_packages(resolved).first().packages == ["@org/pkg", "react"]
