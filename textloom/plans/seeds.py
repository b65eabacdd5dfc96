"""Inputs that make every measure non-zero, defined once for Spark and once for SQL.

The driver's documents hold no stock phrases, colon lists, hedges, prices or Indic
text, so each document gets a snippet by its id, and Indic rows are literals.  All
documents take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SNIPPETS = [
    "",
    "\nMoreover, it is important to note that we delve into a robust plan. Furthermore, in order to win we keep a wide range of tools. Moreover, it helps.",
    "\nHere is why: cost, speed, and scale matter. The list: apples, pears, plums.",
    "\nIt may help , and it might cost Rs. 1,500 or 20 mg of zinc . See https://example.com/a?b=1 or write to info@example.com about 30% off!",
    "\nYou don't need it. We're sure that you'll like our plan. I may be wrong, but my plan is seamless.",
    "\nBased on this evaluation, the implementation was approved. Overall, equality is high. From an angle, the assessment was written.",
    "\nA test — with dashes - and `code` and [a link](http://example.org/x) and <b>bold</b> text. Dose 2.5 ml in 10 days.",
    "\nThe report was given by Ann. The report was written twice. The report was quickly reviewed. The report generally suggests more.",
    "\n\nA first short line of some words.\nA second line that is a good deal longer than the first one was.\nThird line here now, again.\nAnd a fourth line, which ends it all: this, that, and more.",
]


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def seeded_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text: each document with the snippet of its id."""
    docs = table(spark, sf_dir, "documents", "doc_id").select("doc_id", "lang", "text")
    snippet = F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.pmod("doc_id", F.lit(len(SNIPPETS))) + 1).cast("int"))
    return docs.select("doc_id", "lang", F.concat(F.coalesce("text", F.lit("")), snippet).alias("text"))


SEEDED_SQL = (
    "SELECT doc_id, lang, coalesce(text, '') || CASE doc_id % "
    + str(len(SNIPPETS))
    + " "
    + " ".join(f"WHEN {i} THEN {quote(s)}" for i, s in enumerate(SNIPPETS))
    + " END AS text FROM documents"
)

#: Invented sentences for the scripts and signals; (id, language code to measure as, text).
INDIC_ROWS = [
    (1, "hi", "यह दवा , जो नई है , के रूप में दी जाती है । हो सकता है कि यह मदद करे। इसके अलावा यह सस्ती है। इसके अलावा यह अच्छी है।"),
    (2, "hi", "आप यहाँ आइए। तुम कल आना। एवं तथा हेतु सब अत्यंत अच्छा है, जो सही है।"),
    (3, "mr", "याशिवाय हे औषध द्वारे दिले जाते आहे. जो माणूस येतो तो काम करतो आहे, असे दिसते."),
    (4, "bn", "এছাড়াও এটি গুরুত্বপূর্ণ, যা সবাই জানে। এটি হিসাবে পরিচিত এবং ভালো হয়।"),
    (5, "gu", "વધુમાં આ દવા દ્વારા મદદ મળે છે. જે લોકો આવે છે તે સારા છે."),
    (6, "pa", "ਇਸ ਤੋਂ ਇਲਾਵਾ ਇਹ ਚੰਗਾ ਹੈ। ਜੋ ਲੋਕ ਆਉਂਦੇ ਹਨ ਉਹ ਚੰਗੇ ਹਨ।"),
    (7, "ta", "மேலும் இது நல்லது. இது மூலம் கிடைக்கும், எந்த நாளும் வரும் வேண்டும்."),
    (8, "te", "అదనంగా ఇది మంచిది. ఇది ద్వారా వస్తుంది, ఏది మంచిది అది ఉంది."),
    (9, "kn", "ಇದಲ್ಲದೆ ಇದು ಒಳ್ಳೆಯದು. ಇದು ಮೂಲಕ ಬರುತ್ತದೆ, ಯಾವ ದಿನ ಎಂದು ಗೊತ್ತು ಇದೆ."),
    (10, "ml", "കൂടാതെ ഇത് നല്ലതാണ്. ഇത് മുഖേന വരുന്നു, ഏത് ദിവസം ആണ്."),
    (11, "or", "ଏହା ବ୍ୟତୀତ ଏହା ଭଲ। ଏହା ମାଧ୍ୟମରେ ଆସେ, ଯାହା ସମସ୍ତେ ଜାଣନ୍ତି।"),
    (12, "ur", "اس کے علاوہ یہ اچھا ہے، جو سب جانتے ہیں۔ یہ کے ذریعے ملتا ہے."),
    (13, "sat", "ᱥᱟᱱᱛᱟᱲᱤ ᱯᱟᱹᱨᱥᱤ ᱫᱚ ᱵᱮᱥ ᱜᱮᱭᱟ."),
    (14, "mni", "ꯃꯤꯇꯩꯂꯣꯟ ꯐꯖꯕ ꯂꯣꯟ ꯑꯃꯅꯤ."),
    (15, "hinglish", "yeh dawa bahut achhi hai aur ke liye nahi mein kya karna hai, jo sahi hai. iske alawa aap hum sab hain."),
    (16, "hi", "This text was left in English for the most part , and only एक शब्द is not, which a check of scripts finds at once because thirty and more words stand here in Latin letters, row after row, as they do now."),
    (17, "hi", "हर दिन ५०० लोग आते हैं। कीमत ₹ 1,200 है  और 12% छूट है।\n\nदूसरा अनुच्छेद यहाँ है, जो छोटा है।\nतीसरी पंक्ति में चार शब्द हैं।\nचौथी पंक्ति थोड़ी लंबी है और आगे चलती जाती है।\nपाँचवीं पंक्ति भी यहीं है।"),
    (18, "en", "No markup, plain words."),
    (19, "en", "12345 !!!"),
]


def indic_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDIC_ROWS, "id long, lang string, text string")


INDIC_SQL = "SELECT id::BIGINT AS id, lang, text FROM (VALUES " + ", ".join(f"({i}, {quote(c)}, {quote(t)})" for i, c, t in INDIC_ROWS) + ") AS v(id, lang, text)"

#: Edits of the seeded text, one class for each gate; (edit number, what is put at the end or replaced).
HEDGED = "\nIt may reduce risk by about 12 units. The limit is 40 units, often less. The pact holds, the price holds, the term holds, the plan holds."
EDITS = 9


def _edit(c, replace, concat, when):
    """The candidate for each edit number, by the caller's string functions."""
    return when(
        [
            lambda: c,  # no change
            lambda: replace(c, "may reduce", "reduces"),  # a hedge goes
            lambda: replace(c, "The limit is 40 units", "The limit is 45 units"),  # another figure
            lambda: concat(c, " It helps and it holds and it helps and it holds" * 40),  # too long
            lambda: replace(c, "The pact holds", "It holds"),  # a locked term goes
            lambda: replace(c, "holds, the", "holds the"),  # commas go, sentences don't come
            lambda: concat(c, "\n\nA stub."),  # a short paragraph
            lambda: replace(c, "about 12 units", "around 12 units"),  # an equal hedge
            lambda: replace(c, "may reduce", "will reduce"),  # a hedge goes and its claim stands bare
        ]
    )


def revision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, edit, original, predecessor, candidate: seeded documents and one edit of each."""
    docs = seeded_docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit(HEDGED)).alias("original"))
    edit = F.pmod(F.floor(F.col("doc_id") / 3), F.lit(EDITS)).cast("long")

    def when(cases):
        out: Column | None = None
        for i, case in enumerate(cases):
            out = F.when(F.col("edit") == i, case()) if out is None else out.when(F.col("edit") == i, case())
        return out

    put = _edit(F.col("original"), lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)), lambda c, s: F.concat(c, F.lit(s)), when)
    return docs.withColumn("edit", edit).withColumn("candidate", put).withColumn("predecessor", F.col("original"))


REVISIONS_SQL = (
    f"SELECT doc_id, edit, original, original AS predecessor, "
    + _edit("original", lambda c, a, b: f"replace({c}, {quote(a)}, {quote(b)})", lambda c, s: f"{c} || {quote(s)}", lambda cases: "CASE edit " + " ".join(f"WHEN {i} THEN {case()}" for i, case in enumerate(cases)) + " END")
    + f" AS candidate FROM (SELECT doc_id, text || {quote(HEDGED)} AS original, ((doc_id // 3) % {EDITS})::BIGINT AS edit FROM ({SEEDED_SQL}))"
)
