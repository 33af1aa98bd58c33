"""JSON arrays in many byte ranges against a parser that reads them whole."""

from __future__ import annotations

import json
import random

import pytest

from corpusloom.sources import arrays, readers

FIELDS = "a string, b bigint, c array<string>"
ITEM = "struct<a: string, b: bigint, c: array<string>>"


@pytest.fixture
def small_ranges(spark):
    """Ranges of 64 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def plain(files):
    """``name, ord, a, b, c`` of every file that holds a list of objects."""
    out = []
    for name, text in files.items():
        try:
            found = json.loads(text.removeprefix("﻿"))
        except ValueError:
            continue
        if isinstance(found, list) and all(isinstance(x, dict) for x in found):
            out += [(name, i, x.get("a"), x.get("b"), x.get("c")) for i, x in enumerate(found)]
    return sorted(out, key=repr)


def read(spark, folder, files):
    for name, text in files.items():
        (folder / f"{name}.json").write_bytes(text.encode())
    rows = readers.read_examples(spark, str(folder), FIELDS).collect()
    return sorted(((r["source"], r["ord"], r["a"], r["b"], r["c"]) for r in rows), key=repr)


def test_arrays_across_ranges(spark, small_ranges, tmp_path):
    """Strings full of braces, quotes, backslashes and brackets, nested lists, and objects longer than many ranges."""
    draw = random.Random(3)
    odd = ["}", "{", '"', "\\", "[", "]", ",", "\\\\}", '\\"', "é", "　", "x" * 40, "\n", "\t", ": {", "}]", "\U0001f600"]

    def text(most):
        return "".join(draw.choice(odd) for _ in range(draw.randint(0, most)))

    files = {}
    for n in range(12):
        items = [{"a": text(draw.choice([3, 10, 120])), "b": draw.randint(-5, 5), "c": [text(4) for _ in range(draw.randint(0, 3))], "d": {"e": [{}, {"f": text(3)}]}}
                 for _ in range(draw.randint(0, 25))]
        files[f"f{n}"] = json.dumps(items, ensure_ascii=n % 2 == 0, indent=[None, 2, 0][n % 3])
    files["bom"] = "﻿ " + json.dumps([{"a": "1"}])
    assert read(spark, tmp_path, files) == plain(files)


def test_broken_arrays_are_left_out_whole(spark, small_ranges, tmp_path):
    good = ", ".join(json.dumps({"a": f"t{i} }}", "b": i, "c": ["{"]}) for i in range(20))
    files = {
        "good": f"[{good}]", "blank": "", "spaces": " \n ", "empty": " [ ] \n", "object": '{"a": "1"}', "text": '"[]"', "number": "5", "open": f"[{good}",
        "cut": f"[{good}, {{\"a\": \"1", "comma": f"[{good},]", "leading": f"[,{good}]", "double": f"[{good},,{good}]", "missing": f"[{good} {good}]", "behind": f"[{good}] x",
        "closed": f"[{good}]]", "nested": f"[[{good}]]", "late": f"[{good}], {good}", "mixed": f"[{good}, 5, {good}]", "words": f"[{good} x, {good}]",
        "kinds": f"[{good}, {{\"a\": [1}}]", "single": "[{'a': 'x'}]", "quote": f"[{good}, {{\"a\": \"x}}]", "last": f"[{good}, 7]", "ends": f"[{good}, {{\"a\": \"z\"}}\n\t]\n",
    }
    assert {r[0] for r in plain(files)} == {"good", "ends"}
    assert read(spark, tmp_path, files) == plain(files)


def test_a_large_array_is_read_by_many_tasks(spark, small_ranges, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    items = [{"a": f"{i} {{[\"}}", "b": i} for i in range(40_000)]
    (tmp_path / "one.json").write_text(json.dumps(items))
    fragments = arrays._fragments(spark, str(tmp_path), "*.json")
    assert fragments.select("block").distinct().count() > 15
    rows = readers.read_examples(spark, str(tmp_path), "a string, b bigint").collect()
    assert sorted((r["ord"], r["a"], r["b"]) for r in rows) == [(i, x["a"], x["b"]) for i, x in enumerate(items)]


def test_written_arrays(spark, tmp_path):
    rows = [("s1", 3, 'a "}', None), ("s1", 1, None, ["x"]), ("s2", 7, "only", []), ("s1", 2, "é\n", ["y", "}"])]
    arrays.write_arrays(spark.createDataFrame(rows, "source string, ord bigint, a string, c array<string>"), str(tmp_path / "out"))
    found = arrays.array_items(spark, str(tmp_path / "out"), "struct<a: string, c: array<string>>", "*.txt")
    got = sorted((r["file"].split("source=")[1].split("/")[0], r["ord"], r["item"]["a"], r["item"]["c"]) for r in found.collect())
    assert got == [("s1", 0, None, ["x"]), ("s1", 1, "é\n", ["y", "}"]), ("s1", 2, 'a "}', None), ("s2", 0, "only", [])]
    for file in (tmp_path / "out").glob("*/*.txt"):
        assert isinstance(json.loads(file.read_text()), list)
