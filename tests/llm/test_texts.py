import random
import unicodedata
from collections import defaultdict

from graphloom.llm.mixing import mix, mix_report
from graphloom.llm.origin import fingerprints, minified, not_hand_written, says, tabular, _COPY, _Codes, _NOTICE
from graphloom.llm.packing import pack_bucket, pack_documents, pack_report
from graphloom.llm.tokens import count_tokens
from graphloom.llm.visual import look_alike_pairs, visual_form


# -- problem 9
def brute_form(t):
    look = dict(zip("аеорсухіјѕАВЕКМНОРСТХοΡ", "aeopcyxijsABEKMHOPCTXoP"))
    drop = {0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = unicodedata.normalize("NFC", "".join(c for c in t if ord(c) not in drop))
    t = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else " " if ord(c) in (0xA0, 0x2007, 0x202F, 0x3000) else look.get(c, c) for c in t)
    return unicodedata.normalize("NFC", t.replace("ﬁ", "fi").replace("ﬂ", "fl"))


def test_forms_match_brute_force(spark):
    r = random.Random(3)
    alphabet = "abco eé\u0301\u00a0\u200bаосѕｆｏﬁ\r\n\u00adXХI1l²"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(300)] + ["", "x" * 300_000 + "а"]
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)] + [(9999, None, "e")], "doc_id long, text string, form string")
    got = {x["doc_id"]: x["form"] for x in visual_form(df).collect()}
    assert got.pop(9999) is None
    assert got == {i: brute_form(t) for i, t in enumerate(texts)}
    classes = defaultdict(list)
    for i, t in enumerate(texts):
        classes[brute_form(t)].append((i, t))
    want = {(a, b) for v in classes.values() for a, s in v for b, t in v if a < b and s != t}
    assert {tuple(x) for x in look_alike_pairs(df).collect()} == want
    assert look_alike_pairs(df.limit(0)).count() == 0


def test_accents_join_mapped_letters(spark):
    same = [("Käse", "Ka\u0308se"), ("Käse", "K\u0430\u0308se"), ("Käse", "K\u04d3se"), ("né", "n\u0435\u200b\u0301"), ("\u0439", "\u0438\u0306")]
    df = spark.createDataFrame([(2 * i + k, f"{i} {p[k]}") for i, p in enumerate(same) for k in (0, 1)], "doc_id long, text string")
    assert {tuple(r) for r in look_alike_pairs(df).collect()} == {(2 * i, 2 * i + 1) for i in range(len(same))}


def test_copies_are_not_paired_with_each_other(spark):
    from graphloom.llm.visual import look_alike_classes, look_alike_texts

    rows = [(i, "hot text") for i in range(60)] + [(100, "hot\u00a0text"), (101, "hot\u200b text"), (102, "own"), (103, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in look_alike_pairs(df).collect()}
    assert got == {(i, j) for i in range(60) for j in (100, 101)} | {(100, 101)}
    assert {tuple(r) for r in look_alike_texts(df).collect()} == {(0, 100), (0, 101)}
    assert {(r["variants"], r["copies"]) for r in look_alike_classes(df).collect()} == {(3, 62)}


def test_visible_differences_stay(spark):
    pairs = [("a", "A"), ("a", "á"), ("x2", "x²"), ("l", "1"), ("ab", "a b"), ("ν", "v"), ("👨‍👩‍👧", "👨👩👧")]
    df = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    assert look_alike_pairs(df).count() == 0


# -- problem 7
def test_packs_hold_their_capacity():
    r = random.Random(1)
    for cap in (7, 64, 1000):
        sizes = sorted((r.randint(1, cap) for _ in range(500)), reverse=True)
        room = defaultdict(int)
        for s, p in zip(sizes, pack_bucket(sizes, cap)):
            room[p] += s
        assert max(room.values()) <= cap and sum(room.values()) == sum(sizes)
        assert len(room) <= 1.7 * sum(sizes) / cap + 12


def test_pack_documents(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["alpha", "beta", "x"]) for _ in range(r.randrange(0, 90))) for _ in range(60)] + [None, "word " * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7])], "doc_id long, text string")
    spec = spark.createDataFrame([("s", 32), ("m", 128)], "pack_name string, capacity_tokens int")
    got = pack_documents(df, spec, bucket_items=20).collect()
    for name, cap in (("s", 32), ("m", 128)):
        fill = defaultdict(int)
        pieces = defaultdict(list)
        for x in got:
            if x["pack_name"] == name:
                fill[x["bucket"], x["pack"]] += x["n_tokens"]
                pieces[x["doc_id"]].append((x["from_token"], x["n_tokens"]))
        assert max(fill.values()) <= cap
        assert sum(n for p in pieces.values() for _, n in p) == sum(count_tokens(t) or 0 for t in [*texts, texts[7]] if t)
        for p in pieces.values():
            p = sorted(set(p))
            assert [f for f, _ in p] == [cap * k for k in range(len(p))] and all(n == cap for _, n in p[:-1])
    assert {x["pack_name"] for x in pack_report(pack_documents(df, spec)).collect()} == {"s", "m"}
    assert pack_documents(df.limit(0), spec).count() == 0 and pack_documents(df, spec.limit(0)).count() == 0


# -- problem 8
def test_mix(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(5, 60) + str(i), s) for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["low"] * 40)] + [(5000, None, "big"), (5001, "x", None), (5002, "y", "other")]
    rows += [(6000 + i, "same text here for all " * 3, "mid") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("low", 0.15, 4), ("none", 0.05, 1)], "source string, target_share double, max_repeats int")
    got = mix(df, target)
    rep = {x["source"]: x for x in mix_report(got, target).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("low", 0.15)):
        assert abs(rep[s]["actual_share"] - share / 0.95) < 0.01
        assert rep[s]["most_copies"] <= rep[s]["max_repeats"]
    assert rep["none"]["actual_share"] == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mix(df.repartition(3), target).collect()))
    assert mix(df.limit(0), target).count() == 0
    copies = sum(x["copies"] for x in got.collect() if x["doc_id"] >= 6000)
    assert copies <= 4  # fifty equal texts count as one


# -- problem 1
HAND = "import json\n\ndef {n}(a, b):\n    for x in a:\n        y = x + {k}\n        trace('{n}', y)\n    return b * {k}\n"


def body(seed):
    return "".join(HAND.format(n=f"f{seed}_{i}", k=seed * 31 + i) for i in range(6))


def test_notices():
    assert says("// Code generated by x. DO NOT EDIT.\n\npackage a", _NOTICE) and says("# @generated by x\n", _NOTICE) and says('"""\nAutogenerated from a.schema; regenerate\n"""\n', _NOTICE)
    for t in ("// This module is not generated; edit it freely.\n", "# Started from a generated template, kept by hand since.\n", "// Checks whether a header says DO NOT EDIT before it is rewritten.\n", "x = 1\n# Code generated by x. DO NOT EDIT.\n", "// Skips files that were generated by the tool.\n"):
        assert not says(t, _NOTICE), t
    assert says("/* Snapshot of upstream xkit at 1.2 -- do not patch here */\n", _COPY) and not says("# Vendored copies of the table are listed but never touched.\n", _COPY)


def test_form_is_judged_without_comments():
    messages = "module.exports = {\n" + "".join(f'  "key {i}": "a message of many short words that goes on for a while",\n' for i in range(60)) + "}\n"
    assert tabular(messages)
    packed = "".join(f"var a{i}=b(c[{i}],d);" for i in range(40)) + "\n"
    assert minified("// a line of the licence\n" * 80 + packed) and minified("/*\n" + " * a line of the licence\n" * 80 + " */\n" + packed)
    assert not minified("// a line of the licence\n" * 80) and not minified("var a = 1\n" * 80)


def test_notices_behind_long_licences():
    licence = [f"Term {i} of the licence that this text comes under, in words of no interest here." for i in range(120)]
    line, block = "".join(f"// {x}\n" for x in licence), "/*\n" + "".join(f" * {x}\n" for x in licence) + " */\n"
    assert len(line) > 6000
    for head in (line, block, line[:1100] + "\n"):
        assert says(head + "// Code generated by x. DO NOT EDIT.\npackage a\n", _NOTICE)
        assert says(head + "// Vendored from xkit\npackage a\n", _COPY)
        assert not says("// Code generated by x.\n" + head + "// Since then maintained by hand.\npackage a\n", _NOTICE)
        assert not says(head + "package a\n// Code generated by x. DO NOT EDIT.\n", _NOTICE)
    assert not says("/*\n * Kit\n */ var a = 1\n// Code generated by x. DO NOT EDIT.\n", _NOTICE)
    assert says("/* Kit */ /* Code generated by x. */\nvar a = 1\n", _NOTICE)
    assert says("/* Code generated by x. */ var a = 'edit freely'\n", _NOTICE) and says("/*\n * Code generated by x.\n */ var a = 'edit freely'\n", _NOTICE)


def test_forms_of_text():
    assert tabular("var x = []byte{\n" + "0x91, 0xe5, 0xd2,\n" * 60 + "}\n") and tabular('X = "' + "aGVsbG8gd29ybGQ" * 40 + '"\n') and not tabular(body(1))
    assert minified("function a(b){return b+1}" * 60) and not minified(body(1) * 5)


def test_fingerprints_find_moved_copies():
    c = _Codes()
    a, b = set(fingerprints(body(1), c)), set(fingerprints("# added\n\n" + body(1), c))
    assert len(a & b) >= 0.8 * len(a) and not a & set(fingerprints(body(2), c)) and not len(fingerprints("", c))


def test_layout_and_comments_do_not_hide_copies():
    c = {lang: _Codes(lang) for lang in ("javascript", "python")}
    a = "".join(f"function f{i}(a, b) {{\n  const c{i} = a + b * {i}; // note\n  return trace('x', c{i})\n}}\n" for i in range(20))
    b = a.replace("(a, b) {\n", "( a,b ){ /* other\nlicence */\n\n").replace(" // note", "").replace("'x'", '"why"')
    assert set(fingerprints(a, c["javascript"], "javascript")) == set(fingerprints(b, c["javascript"], "javascript"))
    assert len(fingerprints("# only a comment\n", c["python"], "python")) == 0


def test_a_text_collected_again_has_the_same_share(spark):
    from graphloom.llm.origin import recurrence, signs

    part, rest = body(20), "".join(body(21 + i) for i in range(3))
    docs = [("r0", "r0/a.py", part + rest)] * 3 + [(f"r{i}", f"r{i}/b.py", part) for i in range(1, 5)]
    signed = signs(spark.createDataFrame(docs, "repo string, path string, text string")).selectExpr("*", "monotonically_increasing_id() AS d").cache()
    got = {(r["path"], round(r["many"], 3)) for r in signed.join(recurrence(signed), "d").collect()}
    signed.unpersist()
    assert max(s for _, s in got) <= 1 and len({s for p, s in got if p == "r0/a.py"}) == 1 and max(s for p, s in got if p == "r0/a.py") < 0.5


def test_not_hand_written(spark):
    lib, own = body(7), body(8)
    docs = [(f"r{i}", f"r{i}/src/lib.py", lib) for i in range(4)] + [("r0", "r0/a.py", own), ("r0", "r0/a.py", own), ("r1", "r1/fork.py", own)]
    docs += [("r0", "r0/third_party/x-kit/y.py", body(9)), ("r1", "r1/z.py", body(9)), ("r0", "r0/vendor/own.py", body(13)), ("r0", "r0/third_party_billing/y.py", body(10)), ("r0", "r0/g.py", "# @generated by x\n" + body(11)), ("r0", "r0/p_pb2.py", body(12)), ("r0", "r0/e.js", "<!DOCTYPE html>\n<html></html>\n"), ("r0", "r0/n.py", None), (None, "q.py", ""), ("r0", None, "x")]
    files = [(r, p, 100) for r, p, _ in docs] + [("r0", "r0/huge.py", 2 << 20), ("r0", "r0/gone.py", 10), ("r0", "r0/node_modules/z.js", 10), ("r0", "r0/null.py", None)]
    got = {r["path"]: r["reason"] for r in not_hand_written(spark.createDataFrame(files, "repo string, path string, size long"), spark.createDataFrame(docs, "repo string, path string, text string")).collect()}
    assert got == {**{f"r{i}/src/lib.py": "vendored" for i in range(4)}, "r0/third_party/x-kit/y.py": "vendored", "r0/g.py": "generated", "r0/p_pb2.py": "generated", "r0/huge.py": "large", "r0/node_modules/z.js": "vendored"}
    empty = not_hand_written(spark.createDataFrame([], "repo string, path string, size long"), spark.createDataFrame([], "repo string, path string, text string"))
    assert empty.count() == 0
