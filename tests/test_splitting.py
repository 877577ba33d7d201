import random

from pyspark.sql import functions as F
from sparkloom.operators import splitting

PY = "import os\n\n# about f\n@wrap\ndef f():\n    def inner():\n        pass\n\nclass C:\n    def m(self): ...\nx = 1\nasync def g(): pass"
MD = "intro\n\n# One\ntext\n```\n# not a heading\n```\nTitle\n=====\n- item\n---\n#nothing\n  ## Two ##\nend"


def bodies(text, strategy, language=None, most=1000):
    return [text[r[3] : r[4]] for r in splitting.split(text, strategy, language, most)]


def test_python_symbols():
    rows = list(splitting.split(PY, "SYMBOL", "python", 1000))
    assert [r[2] for r in rows] == ["preamble", "symbol", "symbol", "symbol"]
    assert [(r[5], r[6]) for r in rows] == [(1, 2), (3, 8), (9, 11), (12, 12)]
    assert bodies(PY, "SYMBOL", "py")[1].startswith("# about f\n@wrap\ndef f")
    assert [r[1] for r in splitting.split("x = 1\n", "SYMBOL", "python", 1000)] == ["FALLBACK"]


def test_other_languages():
    for language, text, n in (
        ("go", "package a\n\nfunc A() {\n}\n\n// B\ntype B struct {\n}\n", 3),
        ("rust", "use x;\npub fn a() {}\nimpl B for C {\n    fn d() {}\n}\n", 3),
        ("tsx", "import a\nexport default function A() {}\nconst b = async (x) => {\n}\nlet c = 1\n", 3),
        ("java", "package a;\npublic final class A {\n  void m() {}\n}\n", 2),
        ("cpp", "#include <a>\nint f(int a) {\n  return g(a);\n}\nstruct S {\n};\n", 2),
        ("rb", "module A\n  def b; end\nend\ndef c; end\n", 2),
        (None, "def a():\n  pass\nfunc b() {\n}\n", 2),
    ):
        assert len(bodies(text, "SYMBOL", language)) == n, language


def test_markdown_sections():
    assert bodies(MD, "MARKDOWN_SECTION") == ["intro\n\n", "# One\ntext\n```\n# not a heading\n```\n", "Title\n=====\n- item\n---\n#nothing\n", "  ## Two ##\nend"]
    assert [r[2] for r in splitting.split(MD, "MARKDOWN_SECTION", None, 1000)] == ["preamble", "section", "section", "section"]
    assert bodies("~~~\n# a\n```\n# b\n~~~\n# c", "MARKDOWN_SECTION") == ["~~~\n# a\n```\n# b\n~~~\n", "# c"]


def test_no_text_is_lost():
    rng = random.Random(3)
    pieces = [*MD.split("\n"), *PY.split("\n"), "", "  ", "\r", "漢字 é", "x" * 60]
    for _ in range(300):
        text = "\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40)))
        for strategy in ("SYMBOL", "MARKDOWN_SECTION", "PROTO_MESSAGE", None):
            for most in (16, 1000):
                rows = list(splitting.split(text, strategy, rng.choice(("python", "go", None)), most))
                if not text.strip():
                    assert rows == []
                    continue
                assert "".join(text[r[3] : r[4]] for r in rows) == text
                assert [r[0] for r in rows] == list(range(len(rows)))
                assert all(len(text[r[3] : r[4]].encode()) <= most for r in rows)
                assert all(r[5] == 1 + text.count("\n", 0, r[3]) for r in rows)


def test_as_a_lateral_join(spark):
    files = [("a.py", PY, "SYMBOL"), ("b.md", MD, "MARKDOWN_SECTION"), ("c", "one\n", None), ("d", None, "SYMBOL"), ("e", " \n", "SYMBOL"), ("f", "", None)]
    df = spark.createDataFrame(files, "path string, text string, how string")
    found = splitting.chunks(df, "text", F.col("how"), F.lit("python"))
    assert found.columns == ["path", "text", "how", "nth", "strategy", "kind", "start", "end", "start_line", "end_line", "part"]
    n = {r.path: r["n"] for r in found.groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert n == {"a.py": 4, "b.md": 4, "c": 1}
    assert splitting.chunks(df.limit(0), "text", F.col("how"), F.lit("python")).count() == 0
