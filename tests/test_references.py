"""Character references against the standard library, all names and malformed ones."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from skein.functions import references


def test_references_equal_the_standard_table(spark):
    dice = random.Random(1)
    texts = [f"x&{n} y" for n in html5] + [f"&{n.rstrip(';')}z;&{n.rstrip(';')}" for n in html5]
    texts += [f"a&#{n};b&#x{n:x}c&#X0{n:X};" for n in [*range(0, 260), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x1FFFF, 0x10FFFF, 0x110000, 99999999999999999999]]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "&#xg;", "& amp;", "&amp", "&ampamp;", "&amp;amp;lt;", "&notit;", "&notin;", "&#0000000065;", "&#000", "&" + "x" * 40 + ";", "no references", "&lt&gt", "é&eacute\n&#233"]
    texts += ["".join(dice.choice(["&", "#", "x", "amp", "lt", ";", "6", "5", " ", "not", "in", "é"]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(t, html.unescape(t)) for t in texts] + [(None, None)], "t string, want string").repartition(4)
    wrong = df.withColumn("got", references.unescape(F.col("t"))).filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
    assert not wrong, wrong[:5]
