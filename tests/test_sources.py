"""Chunks, endpoints and walks over small source files of every language."""

from pyspark.sql import functions as F

from lodestone.sources import chunkers

FILES = {
    ("a.py", "python"): "class Oven:\n    class Door:\n        def open(self):\n            return 1234\n\n    def heat(self):\n        return 5678\n\n\nasync def bake(x):\n    return x + 1\n",
    ("a.rs", "rust"): "struct Oven {\n    t: i32,\n}\n\nimpl fmt::Display for Oven {\n    pub fn heat(&self) -> i32 {\n        self.t\n    }\n}\n\nfn bake(x: i32) -> i32 {\n    x\n}\n",
    ("a.js", "javascript"): "class Oven {\n  heat(t) {\n    if (t) {\n      go();\n    }\n  }\n}\nexport const bake = (x) => {\n  return x;\n};\n",
    ("a.ts", "typescript"): "export interface Heat {\n  t: number;\n}\nexport class Oven {\n  private async heat(t: number): Promise<void> {\n    return;\n  }\n}\n",
    ("a.go", "go"): "type Oven struct {\n\tt int\n}\n\nfunc (o *Oven) Heat(t int) {\n\to.t = t\n}\n\nfunc Bake(x int) int {\n\treturn x\n}\n",
    ("a.php", "php"): "class Oven {\n    public function heat($t) {\n        return $t;\n    }\n}\nfunction bake($x) {\n    return $x;\n}\n",
    ("a.cpp", "cpp"): "class Oven {\n  int t;\n};\n\nint Oven::heat(int t) {\n  return t;\n}\n",
    ("a.swift", "swift"): "public class Oven {\n    func heat(t: Int) {\n        print(t)\n    }\n}\n",
    ("a.kt", "kotlin"): "class Oven {\n    fun heat(t: Int) {\n        println(t)\n    }\n}\n",
    ("a.tf", "hcl"): 'resource "oven" "one" {\n  heat = 5\n}\n',
    ("e.py", "python"): "",
    ("n.py", "python"): None,
    ("x.zig", "zig"): "fn heat() void {}\n",
}
WANT = {
    "python": {("Oven", "class", 1, 7, None), ("Door", "class", 2, 4, "Oven"), ("open", "function", 3, 4, "Door"), ("heat", "function", 6, 7, "Oven"), ("bake", "function", 10, 11, None)},
    "rust": {("Oven", "struct", 1, 3, None), ("Oven", "impl", 5, 9, None), ("heat", "function", 6, 8, "Oven"), ("bake", "function", 11, 13, None)},
    "javascript": {("Oven", "class", 1, 7, None), ("heat", "method", 2, 6, "Oven"), ("bake", "function", 8, 10, None)},
    "typescript": {("Heat", "interface", 1, 3, None), ("Oven", "class", 4, 8, None), ("heat", "method", 5, 7, "Oven")},
    "go": {("Oven", "struct", 1, 3, None), ("Heat", "function", 5, 7, "Oven"), ("Bake", "function", 9, 11, None)},
    "php": {("Oven", "class", 1, 5, None), ("heat", "function", 2, 4, "Oven"), ("bake", "function", 6, 8, None)},
    "cpp": {("Oven", "class", 1, 3, None), ("heat", "function", 5, 7, "Oven")},
    "swift": {("Oven", "class", 1, 5, None), ("heat", "function", 2, 4, "Oven")},
    "kotlin": {("Oven", "class", 1, 5, None), ("heat", "function", 2, 4, "Oven")},
    "hcl": {("resource", "block", 1, 3, None)},
}


def files(spark, rows):
    return spark.createDataFrame(rows, "file_path string, language string, content string")


def test_every_language_gives_chunks_with_parents(spark):
    rows = chunkers.parse(files(spark, [(*k, v) for k, v in FILES.items()]), "r").collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r.language, set()).add((r.symbol_name, r.node_type, r.start_line, r.end_line, r.parent_symbol))
    assert got == WANT
    assert len({r.id for r in rows}) == len(rows)


def test_a_long_file_is_one_row_until_its_chunks(spark):
    text = "\n".join(f"def f{i}():\n    return {i} + 1000\n" for i in range(2000))
    got = chunkers.parse(files(spark, [("long.py", "python", text)]), "r").agg(F.count("*"), F.max("end_line"), F.max(F.size(F.split("content", "\n")))).first()
    assert tuple(got) == (2000, 5999, 2)


def test_endpoints_over_lines_and_by_names(spark):
    from lodestone.sources import detectors

    rows = [
        ("kiln/settings.py", "python", "import os\n\nBATCHES = os.environ.get('BATCH_TOPIC', 'kiln.batches')\nGLAZE_URL = \"http://glaze/api/coats\"\n"),
        ("kiln/run.py", "python", "import settings\n\ndef go(producer):\n    requests.post(\n        settings.GLAZE_URL,\n        json={},\n    )\n    producer.send(\n        BATCHES, b'')\n    producer.send('kiln.done', b'')\n    requests.get(where_to(1))\n"),
        ("glaze/config.js", "javascript", "module.exports = {\n  topic: process.env.COATS || 'glaze.coats',\n  group: 'g',\n};\n"),
        ("glaze/work.js", "javascript", "class Work {\n  constructor(config) {\n    this.topic = config.topic;\n  }\n  run() {\n    consumer.subscribe({\n      topics: [\n        this.topic,\n      ],\n    });\n    axios.get('/a'); axios.get('/b'); fetch(unknown)\n  }\n}\n"),
        ("e.js", "javascript", ""),
        ("n.js", "javascript", None),
    ]
    own = files(spark, rows)
    found = detectors.extract(own, "r")
    got = {(r.file_path, r.line, r.protocol, r.role, r.channel_raw, r.resolved) for r in found.collect()}
    assert got == {
        ("kiln/run.py", 4, "http", "producer", "settings.GLAZE_URL", False),
        ("kiln/run.py", 8, "kafka", "producer", "BATCHES", False),
        ("kiln/run.py", 10, "kafka", "producer", "kiln.done", True),
        ("glaze/work.js", 6, "kafka", "consumer", "this.topic", False),
        ("glaze/work.js", 11, "http", "producer", "/a", True),
        ("glaze/work.js", 11, "http", "producer", "/b", True),
        ("glaze/work.js", 11, "http", "producer", "unknown", False),
    }
    named = {r.line: (r.channel_raw, r.resolved, r.env_var) for r in detectors.resolve_names(found, own).collect() if r.role == "consumer" or r.file_path == "kiln/run.py" or r.channel_raw == "unknown"}
    assert named == {
        4: ("http://glaze/api/coats", True, None),
        8: ("kiln.batches", True, "BATCH_TOPIC"),
        10: ("kiln.done", True, None),
        6: ("glaze.coats", True, "COATS"),
        11: ("unknown", False, None),
    }


def test_walk_follows_the_ignore_files_of_the_tree(spark, tmp_path):
    from lodestone.sources import walk

    for name, text in {
        "a.py": "x", "pkg/__init__.py": "y", "_tools/_gen/make.rs": "z", ".hid/b.py": "", "pkg/.c.py": "", "notes.txt": "", "odd name%20.py": "o",
        ".gitignore": "/build/\n*.gen.py\n!keep.gen.py\n", "build/d.py": "d", "pkg/e.gen.py": "", "pkg/keep.gen.py": "k",
        "pkg/.gitignore": "local.py\n/top.py\n!e2.gen.py\n", "pkg/local.py": "", "local.py": "l", "pkg/top.py": "", "pkg/sub/top.py": "t", "pkg/e2.gen.py": "e", "vendor/v.py": "",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.file_path: r.content for r in walk.source_files(spark, str(tmp_path), ["vendor/"]).collect()}
    assert got == {"a.py": "x", "pkg/__init__.py": "y", "_tools/_gen/make.rs": "z", "odd name%20.py": "o", "pkg/keep.gen.py": "k", "local.py": "l", "pkg/sub/top.py": "t", "pkg/e2.gen.py": "e"}
    every = [r.file_path for r in walk.source_files(spark, str(tmp_path), tree_rules=False).collect()]
    assert "build/d.py" in every and "vendor/v.py" in every and len(every) == len(set(every)) == 13
