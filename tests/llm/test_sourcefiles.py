"""Problem 1: files that are not hand-written."""

import datetime as dt
import random

from corpusloom.llm.sourcefiles import masked_tokens, not_hand_written, shingles

AT = dt.datetime(2024, 1, 1)
FILES = "file_id long, repo string, rel_path string, content_type string, content string, scanned_at timestamp"


def found(spark, rows):
    """file_ids that are cases; rows: (file_id, rel_path, content_type, content)."""
    files = spark.createDataFrame([(k, "r", p, ct, text, AT) for k, p, ct, text in rows], FILES)
    ingested = spark.createDataFrame([], "id long, repository_id long, rel_path string")
    repos = spark.createDataFrame([(1, "r")], "id long, name string")
    return {r.row_id for r in not_hand_written(files, ingested, repos).collect() if r.tab == "source_files"}


def test_vendor_folder_needs_no_header_elsewhere(spark):
    body = "\npublic class A {\n  int a(int b) {\n    return b + 1;\n  }\n}\n"
    rows = [
        (1, "m/ext/wickerjson/A.java", "java", "package org.wickerjson.core;\n" + body),
        (2, "m/vendor/wickerjson/util.py", "python", "def a(b):\n    return b\n"),
        (3, "m/src/com/northmere/vendor/wickerjson/B.java", "java", "package com.northmere.vendor.wickerjson;\nimport org.wickerjson.A;\n// Copyright (c) 2021 Northmere Retail Platform\n" + body),
        (4, "m/vendor/onboarding/C.java", "java", "package com.northmere.onboarding;\n" + body),
        (5, "m/deps/tinloom/x.js", "javascript", 'import { a } from "./a";\nimport b from "tinloom/b";\nexport const c = a + b;\n'),
    ]
    assert found(spark, rows) == {1, 2, 5}


def test_notices_of_any_depth_before_the_first_code(spark):
    licence = "".join(f"// Licensed under the terms, part {k}.\n" for k in range(30)) + "\n"
    code = "\nfunc A(b int) int {\n\treturn b\n}\n"
    other = "\ntype B struct {\n\tc map[string]chan int\n}\n\nfunc (b *B) D() {\n\tfor k, v := range b.c {\n\t\tgo use(k, <-v)\n\t}\n}\n"
    rows = [
        (1, "a/x.go", "go", licence + "// Code generated by stubgen. DO NOT EDIT.\n\npackage a\n" + code),
        (2, "a/X.java", "java", "/*\n   Some words first.\n   This file was automatically generated.\n*/\npackage a;\n\nclass X { int a; }\n"),
        (3, "a/y.html", None, "<!--\n  Auto-generated file\n-->\n<p>text</p>\n"),
        (4, "a/y.go", "go", "// Code generated by stubgen\n// DO NOT EDIT.\npackage a\n" + code),
        (5, "a/z.go", "go", "package a\n" + other + "\n// Code generated by stubgen. DO NOT EDIT.\nvar c = 1\n"),
        (6, "a/w.go", "go", "// Reads files that say: code generated by stubgen, do not edit.\npackage a\n" + other),
        (7, "a/v.py", "python", '"""Tools.\n\nCopyright 2020 The Quillstack Authors\n"""\nx = 1\n'),
    ]
    assert found(spark, rows) == {1, 2, 3, 4, 7}


def test_smallest_id_of_a_generated_family(spark):
    code = "package a\n\ntype A struct {\n\tb map[string]int\n\tc []byte\n}\n\nfunc (a *A) Get(k string) int {\n\tif v, ok := a.b[k]; ok {\n\t\treturn v\n\t}\n\treturn 0\n}\n"
    more = code + "\nfunc (a *A) Len() int {\n\treturn len(a.c)\n}\n"
    note = "// Code generated by stubgen. DO NOT EDIT.\n"
    rows = [(1, "x/a.go", "go", code), (2, "x/b.go", "go", note + code), (3, "x/c.go", "go", note + more), (4, "x/d.go", "go", more), (5, "x/e.py", "python", "def f(a):\n    return [x for x in a if x > 1]\n")]
    assert found(spark, rows) == {1, 2, 3, 4}


def test_minified_of_any_length_and_wrapping(spark):
    one = "!function(e,t){var n=e.q||(e.q=[]);n.push(t);for(var r=0;r<n.length;r++)n[r](e,r)}(this,function(a,b){return a[b]});"
    wrapped = "\n".join("var a=b.c(d),e=f[g]||{};h(a,function(i){return i.j(e)?k(i,a):l[i]&&m(e)});if(a){n(e)}else{o(a,e)}" for _ in range(4))
    plain = "export function keep(a, b) {\n  const found = a.filter((x) => x.id === b.id);\n  return found.length ? found[0] : null;\n}\n"
    rows = [(1, "a/one.js", "javascript", one), (2, "a/two.js", "javascript", wrapped), (3, "a/plain.js", "javascript", plain), (4, "a/t.js", "javascript", "export const A = 1;\n")]
    assert found(spark, rows) == {1, 2}


def test_many_noticed_shapes_of_one_family(spark):
    r = random.Random(8)
    words = "if else for while return switch case break continue throw try catch finally do new null this true false super".split()
    line = lambda: " ".join(r.choice(words) + r.choice("+-*<>=&|") for _ in range(6)) + ";\n"
    shared = "".join(line() for _ in range(30))
    rows, at = [], 1
    for _ in range(150):  # variants are alike to the file beside them, to other variants mostly not
        own = "".join(line() for _ in range(5))
        rows += [(at, f"g/N{at}.java", "java", "// Code generated by stubgen. DO NOT EDIT.\n" + shared + own), (at + 1, f"g/N{at}.java", "java", shared + own + "".join(line() for _ in range(6)))]
        at += 2
    rows += [(at + k, f"h/H{k}.java", "java", "".join(line() for _ in range(30))) for k in range(20)]
    gen = {k for k, _, _, text in rows if text.startswith("//")}
    sets = {k: set(shingles(masked_tokens(text, False)).tolist()) for k, _, _, text in rows}
    near = {k: {j for j in sets if len(sets[k] & sets[j]) * 5 >= 4 * len(sets[k] | sets[j])} for k in gen}
    want = gen | {j for k in gen if len(near[k] & gen) * 5 >= len(near[k]) for j in near[k]}
    assert len(want) == 300 and all(len(x) < 30 for x in near.values())
    assert found(spark, rows) == want
