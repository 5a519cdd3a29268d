import re

from meshq.llm import licenses

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted. Neither the name of the copyright holder nor the names of its
contributors may be used"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software"""
GPL = """you can redistribute it and/or modify
it under the terms of the GNU General
Public License as published"""
NAMES = {"the GNU Lesser  General\nPublic License,\nversion 2.1": "lgpl-2.1", "under the Mozilla\n   Public License 2.0": "mpl-2.0", "Creative\nCommons Attribution\n4.0": "cc-by-4.0", "Apache\nLicense, Version\n2.0": "apache-2.0"}


def marked(text, mark):
    return "\n".join(mark + x for x in text.split("\n"))


MARKS = ["", " * ", "# ", "// ", ";; ", "   "]


def test_wrapped_texts(spark):
    want = {BSD: {"bsd", "bsd-3-clause"}, ISC: {"isc"}, ZLIB: {"zlib"}, MIT: {"mit"}, BOOST: {"boost"}, GPL: {"gpl"}} | {t: {x} for t, x in NAMES.items()}
    rows = [(m, t) for m in MARKS for t in want]
    df = spark.createDataFrame([(i, marked(t, m)) for i, (m, t) in enumerate(rows)], "doc_id long, text string")
    got = licenses.license_scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        mark, text = rows[r.doc_id]
        assert want[text] <= set(r.labels.split(",")), (mark, text, r.labels)


def test_keywords_are_single_words():
    assert not [r for r in licenses.RULES if re.search(r"\s", r[2] + r[3]) or not r[2]]
