"""Training texts with known sentence ends, from templates and small lexicons, in Spark SQL only (§2.10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = ("Dr.", "Mr.", "Mrs.", "Prof.", "Capt.", "Judge")
NAMES = ("Alder", "Brook", "Cray", "Dunmore", "Ellery", "Fenn")
FIRMS = ("Orrin Co.", "Tamber Inc.", "Wold Ltd.", "Pell & Sons", "Norrow Corp.")
ACTS = ("signed the lease", "closed the file", "paid the fee in full", "left at 5 p.m. on Friday", "sent 3.5 tons to the yard")
TAILS = ("The matter ended there.", "Was it enough?", "Nobody objected!", "It cost $4.20 a unit.")


def _pick(items: tuple[str, ...], seed: int, *salt: Column) -> Column:
    index = F.pmod(F.xxhash64(F.lit(seed), *salt), F.lit(len(items))) + 1
    return F.element_at(F.array(*map(F.lit, items)), index.cast("int"))


def generate(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """``(doc_id, text, spans)``: one or two template sentences (seven in ten have one) and a tail, with their spans in code points.

    Each record depends on its id and the seed alone, whatever the partitioning.
    """
    rows = spark.range(count).withColumnRenamed("id", "doc_id")
    one = F.concat_ws(" ", _pick(TITLES, seed, F.col("doc_id"), F.lit(1)), _pick(NAMES, seed, F.col("doc_id"), F.lit(2)), F.lit("of"), _pick(FIRMS, seed, F.col("doc_id"), F.lit(3)), _pick(ACTS, seed, F.col("doc_id"), F.lit(4)))
    two = F.concat_ws(" ", _pick(NAMES, seed, F.col("doc_id"), F.lit(5)), _pick(ACTS, seed, F.col("doc_id"), F.lit(6)))
    second = F.when(F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.lit(7)), F.lit(10)) >= 7, F.array(F.concat(two, F.lit(".")))).otherwise(F.array().cast("array<string>"))
    sentences = F.concat(F.array(F.concat(one, F.lit("."))), second, F.array(_pick(TAILS, seed, F.col("doc_id"), F.lit(8))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: Column, s: Column) -> Column:
        end = state["at"] + F.length(s)
        return F.struct((end + 1).alias("at"), F.concat(state["spans"], F.array(F.struct(state["at"].alias("start"), end.alias("end")))).alias("spans"))

    rows = rows.withColumn("s", sentences)
    return rows.select("doc_id", F.array_join("s", " ").alias("text"), F.aggregate("s", zero, step)["spans"].alias("spans"))


#: Sentences for training a segmenter; each ends where it ends. Slots: T title, N name, F first name, C firm, M money, P place, D day or month, L citation.
CASES = (
    "{T} {N} of {C} signed the lease.", "{N} left {P} at 5 p.m. on {D}.", "{T} {N} and {T} {F} {N} met in {P}.", "The fee was {M} in all.", "{F} {N} paid {M} to {C} last year.", "Was {T} {N} there?",
    "Nobody at {C} objected!", "See {L} for the rule.", "The court cited {L} twice.", '"We will go," said {N}.', '{N} said, "We will go."', "“It is late,” {F} said.", "{F} said, “It is late.”", "(The file is closed.)",
    "{N} waited (see {L}) and left.", "They sold apples, pears, etc. to {C} in {P}.", "The rate rose 3.5 percent in {D}.", "Version 2.{K} came out in {D}.", "{F} J. {N} wrote it.", "J. R. {N} lives in {P}.", "The U.S. economy grew.",
    "He moved to the U.S. in {D}.", "She works at {C}.", "The meeting ended at 9 a.m.", "They came from {P}, i.e. the north.", "Some birds, e.g. gulls, stay.", "What a day!", "“Stop!” cried {N}.", '"Why?" asked {F}.', "Is it true that {N} left?",
    "I wonder... maybe not.", "It was... odd.", "And then… nothing.", "He wrote to {F} at {C}, {P}.", "No. {K} was missing.", "Fig. {K} shows the plan.", "On Jan. {K} the {C} office closed.", "The St. {N} church is old.", "Prof. {N} taught {F}.",
    "{N} vs. {N} was settled.", "It weighs 5 lbs. at most.", "The road (built by {C}) is wide.", "She asked, “Is it far?”", "He shouted, “Run!”", "They won 3.{K} million.", "Ask {T} {N}'s clerk.", "It's {F}'s turn.", "The dogs' bowls were empty.",
    "{N} holds a Ph.D. in law.", "{N} has a Ph.D.", "The firm is {C}", "We met {F} {N} Jr. in {P}.", "Visit www.{K}.example.org for more.", "The ratio is 1.{K} to 2.", "Turn left on {N} Ave. and stop.", "He lives on {N} St.", "[This part is new.]",
    "The words “so be it” were struck.", "They called it ‘the pit’ for years.", "He said 'fine' and left.", "A so-called “expert” spoke.", "The vote was 5-4.", "Then came the rain.", "It cost {M}.", "Art. {K} sec. {K} applies.", "{T} {N}, M.D., signed.",
)
SLOTS = {
    "{T}": ("Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Capt.", "Sen.", "Rev.", "Lt.", "Gov."), "{N}": ("Alder", "Brook", "Cray", "Dunmore", "Ellery", "Fenn", "Garr", "Holm", "Ives", "Jarrow"), "{F}": ("Ann", "Ben", "Cleo", "Dan", "Eve", "Finn", "Gus"),
    "{C}": ("Orrin Co.", "Tamber Inc.", "Wold Ltd.", "Pell & Sons", "Norrow Corp.", "Quill Bros.", "Rand Group", "Stell L.L.C."), "{M}": ("$4.20", "$1.5 million", "300 euros", "$12,000", "5.75 pounds"),
    "{P}": ("Avon", "Bath", "Delft", "Essen", "Fulda", "Mt. Holm", "Ft. Cray", "St. Ives"), "{D}": ("Friday", "May", "Sept.", "Monday", "Oct.", "2019", "June"), "{L}": ("Fenn v. Cray, 12 U.S. 3", "5 U.S.C. 40", "sec. 12", "ch. 3, p. 9", "vol. 2, no. 4", "Id. at 5"),
    "{K}": ("1", "2", "3", "7", "12", "40"),
}
GAPS = (" ", " ", " ", " ", "  ", "\n", "\n\n")


def sentence_cases(spark: SparkSession, count: int, most: int = 5, seed: int = 0) -> DataFrame:
    """``(doc_id, text, ends)``: one to ``most`` sentences of ``CASES`` with gaps between them, and where each ends in code points.

    As with ``generate``, a record depends on its id and the seed alone.
    """
    at = lambda k: _pick(CASES, seed, F.col("doc_id"), k)

    def filled(k: Column) -> Column:
        value = lambda values, n: _pick(values, seed, F.col("doc_id"), k, F.lit(100 + n))
        slots = [F.struct(F.lit(slot).alias("slot"), value(values, 2 * n).alias("first"), value(values, 2 * n + 1).alias("rest")) for n, (slot, values) in enumerate(SLOTS.items())]

        def put(out: Column, x: Column) -> Column:  # one value at the first place of a slot, another one at the others
            parts = F.split(out, F.concat(F.lit("\\Q"), x["slot"], F.lit("\\E")), -1)
            rest = F.call_function("array_join", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), x["rest"])
            return F.when(F.size(parts) == 1, out).otherwise(F.concat(parts[0], x["first"], rest))

        return F.aggregate(F.array(*slots), at(k), put)

    size = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(most)) + 1).cast("int")
    rows = spark.range(count).withColumnRenamed("id", "doc_id").select("doc_id", F.transform(F.sequence(F.lit(1), size), lambda k: filled(k)).alias("s"), size.alias("size"))
    gap = lambda k: F.when(k == F.col("size"), "").otherwise(_pick(GAPS, seed, F.col("doc_id"), k, F.lit(99)))
    rows = rows.withColumn("g", F.transform(F.sequence(F.lit(1), F.col("size")), gap))
    text = F.array_join(F.zip_with("s", "g", lambda s, g: F.concat(s, g)), "")
    sizes = F.zip_with("s", "g", lambda s, g: F.struct(F.length(s).cast("long").alias("s"), F.length(g).cast("long").alias("g")))
    ends = F.transform(F.sequence(F.lit(1), F.col("size")), lambda k: F.aggregate(F.slice(sizes, 1, k), F.lit(0).cast("long"), lambda a, x: a + x["s"] + x["g"]) - F.element_at(sizes, k)["g"])
    return rows.select("doc_id", text.alias("text"), ends.alias("ends"))
