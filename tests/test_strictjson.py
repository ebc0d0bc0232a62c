"""The spelling of JSON texts of all kinds, and what is none."""

import random

from sparkmill.functions import strictjson


def by_hand(text):
    try:
        return strictjson.dump(strictjson.parse(text))
    except ValueError:
        return None


def test_canonical_texts_of_all_kinds(spark):
    r = random.Random(1)
    texts = [
        "", " ", "null", " true ", "-0", "0", "01", "+1", "1 2", "{} x", "[1]]", "{}{}", '{"a":1,"a":2}', '{"b":1, "a" : [ 1 , {"z":null,"y":"é"} ]}', '{"￿":1,"😀":2}', '{"a":"\t"}', '{"a":"\x7f"}',
        "{'a':1}", "'a'", "{a:1}", "[1,]", "/* */1", "NaN", "Infinity", "-Infinity", "[NaN]", '"NaN"', '{"I":"N"}', "123456789012345", "1234567890123456", "12345678901234567890123", "1.0", "1e5", '"1.0"', '{"1.5":2}', '"a\\u00e9"', '"\\ud800"', '"\\n"', '{"a":1}\n', "﻿1", " 1",
        '"' + "x" * 500 + '"', "[" * 128 + "]" * 128, "[" * 129 + "]" * 129, "[" * 20 + "]" * 19, '{"a":{"b":{"c":[]}}}', '{"B":1,"a":2,"Ä":3,"":4}', '" "', '{"k":"[[[["}', '["\'"]', "tru", "nulll", '{"a" 1}', '{"a":}', '"open', "[1 2]",
    ]

    def value(depth):
        kind = r.randrange(7 if depth else 5)
        if kind == 5:
            return "[" + r.choice([",", " , "]).join(value(depth - 1) for _ in range(r.randrange(4))) + "]"
        if kind == 6:
            return "{" + ",".join(f'"{r.choice("abcÄé/<&")}{r.choice(["", "x"])}":{r.choice(["", " "])}{value(depth - 1)}' for _ in range(r.randrange(4))) + "}"
        return [str(r.randrange(-999, 999)), r.choice(["true", "false", "null"]), f'"{r.choice(["", "x y", "é", "{1.5}", "Z"])}"', str(r.random()), r.choice(["1E2", '"\\t"', "7"])][kind]

    texts += [value(4) for _ in range(400)]
    texts += [t[: r.randrange(len(t) + 1)] + r.choice(["", "]", "}", " ", "x", ","]) for t in texts[-200:]]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, t string")
    got = {x.k: x.c for x in df.select("k", strictjson.canonical("t").alias("c")).collect()}
    assert [got[k] for k in range(len(texts))] == [by_hand(t) for t in texts] and got[-1] is None
    assert sum(c is not None for c in got.values()) > 300
