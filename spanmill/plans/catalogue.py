"""All queries outside ``llm`` and their SQL twins: one function each, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.functions import predicates as Q
from spanmill.functions import text as T
from spanmill.operators import candidates as C
from spanmill.operators import decode as D
from spanmill.operators import features as X
from spanmill.operators import kernels as K
from spanmill.operators import lines as L
from spanmill.operators import metrics as A
from spanmill.operators import models as M
from spanmill.operators import nets as N
from spanmill.operators import packed
from spanmill.operators import positions as P
from spanmill.operators import sampling as S
from spanmill.operators import spans as R
from spanmill.plans import oracle, segmenter
from spanmill.plans.pipeline import Pipeline
from spanmill.sources import bundles, generate, pages

QUERIES: dict = {}


#: Bytes of files up to which a table may be dealt out.
DEAL_BYTES = 1 << 30


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out where it is small and its files give fewer partitions than there are cores.

    A file of one row group is one task; the round robin costs one shuffle of a
    table of ``DEAL_BYTES`` at most, and never happens to a larger one.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows if size > DEAL_BYTES or rows.rdd.getNumPartitions() >= 2 * cores else rows.repartition(2 * cores)


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def conversations(spark, sf_dir) -> DataFrame:
    """``(doc_id, text)``: each conversation as one text, turns as ``role: text`` paragraphs."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    grouped = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(turns.alias("turns"))
    return grouped.select("doc_id", F.array_join(F.transform("turns", lambda t: t["line"]), "\n\n").alias("text"))


def structured(spark, sf_dir) -> DataFrame:
    """``(doc_id, text)``: documents under a heading, with a list and a metadata line."""
    head = F.concat(F.lit("# "), F.coalesce("source", F.lit("none")), F.lit("\n\nLang: "), F.coalesce("lang", F.lit("none")), F.lit("\n1. first item\n- second item\n\n"))
    return documents(spark, sf_dir).select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


@query
def ascii_flags(spark, d):
    """ASCII texts and sizes by language."""
    return documents(spark, d).groupBy("lang").agg(
        F.count_if(T.is_ascii("text")).alias("ascii"), F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(F.octet_length("text")).cast("long").alias("bytes")
    )


@query
def scalar_table(spark, d):
    """Code points of all texts, counted."""
    chars = documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("ch"))
    return chars.groupBy("ch").agg(F.count("*").alias("n"), F.min(F.octet_length("ch")).cast("long").alias("width"))


@query
def offset_maps(spark, d):
    """Middle of each text as code point, byte and back."""
    mid = documents(spark, d).select("doc_id", "text", F.floor(F.length("text") / 2).alias("at"))
    b = mid.withColumn("at_byte", T.char_to_byte("text", "at").cast("long"))
    return b.select("doc_id", "at", "at_byte", T.byte_to_char("text", "at_byte").cast("long").alias("back"))


@query
def normalise_text(spark, d):
    """Tags stripped, white space squeezed, trailing blanks cut."""
    tagged = F.concat(F.lit("<|section|>"), F.coalesce("source", F.lit("")), F.lit("</|section|> &#xD; "), "text", F.lit("<|/paragraph|>  \n"))
    return documents(spark, d).select("doc_id", F.md5(T.squeeze(T.strip_tags(tagged)).cast("binary")).alias("digest"), T.trimmed_length(T.strip_tags(tagged)).cast("long").alias("trimmed"))


@query
def byte_encoders(spark, d):
    """Ordinal codes of all ASCII characters by count."""
    chars = documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("ch"))
    return chars.groupBy(T.encoded_byte(T.char_code("ch")).cast("long").alias("code")).agg(F.count("*").alias("n"))


@query
def unicode_groups(spark, d):
    """Unicode category groups of each language's characters."""
    groups = {"letter": r"\p{L}", "mark": r"\p{M}", "number": r"\p{N}", "punctuation": r"\p{P}", "symbol": r"\p{S}", "separator": r"\p{Z}", "upper": r"\p{Lu}", "lower": r"\p{Ll}"}
    return documents(spark, d).groupBy("lang").agg(*[F.sum(F.regexp_count("text", F.lit(p))).cast("long").alias(n) for n, p in groups.items()])


@query
def scan_byteset(spark, d):
    """Byte offsets of full stops, exclamation and question marks."""
    return C.scan_set(documents(spark, d), ".!?").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"), F.sum("position").alias("total"))


@query
def scan_utf8_set(spark, d):
    """Byte offsets of some non-ASCII letters."""
    return C.scan_set(documents(spark, d), "éüñß").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.sum("position").alias("total"))


@query
def scan_stride(spark, d):
    """Every 512th byte."""
    return C.scan_stride(documents(spark, d), 512)


@query
def scan_line_starts(spark, d):
    """Byte offsets of line starts."""
    return C.scan_line_starts(documents(spark, d))


@query
def cand_exhaustive(spark, d):
    """A candidate behind every code point, summed by document."""
    return C.exhaustive(documents(spark, d)).groupBy("doc_id").agg(
        F.count("*").alias("candidates"), F.sum("feature_pos").alias("positions"), F.max("break_end").alias("last_break"), F.count_if(F.col("break_end") - F.col("feature_pos") > 1).alias("wide")
    )


@query
def cand_terminators(spark, d):
    """Possible sentence ends."""
    return C.sentence_terminators(documents(spark, d))


@query
def cand_lines(spark, d):
    """Trimmed non-blank lines with offsets."""
    return C.lines(structured(spark, d)).select("doc_id", "line_no", "start", "end", "start_byte", "end_byte", F.md5(F.col("line").cast("binary")).alias("digest"))


@query
def cand_punct_v1(spark, d):
    """Terminators judged by their neighbours."""
    return C.punctuation_breaks(documents(spark, d), 1)


@query
def cand_punct_v2(spark, d):
    """P10: with ellipsis and closers."""
    return C.punctuation_breaks(conversations(spark, d), 2)


@query
def cand_paragraph(spark, d):
    """Paragraph breaks."""
    return C.paragraph_breaks(conversations(spark, d))


@query
def cand_union(spark, d):
    """Both kinds of breaks, each once."""
    return C.union_breaks(conversations(spark, d))


@query
def spans_paragraph(spark, d):
    """Paragraphs of conversations."""
    return C.paragraphs(conversations(spark, d)).select("doc_id", "k", "start", "end", F.md5(F.col("value").cast("binary")).alias("digest"))


@query
def windows_sentence(spark, d):
    """P20: runs of up to four consecutive paragraphs of 200 to 2000 characters."""
    return C.windows(C.paragraphs(conversations(spark, d)), 200, 2000, 4)


@query
def chunks_fixed(spark, d):
    """Chunks of 1000 characters, the last kept from 200 characters on."""
    chunks = documents(spark, d).select("doc_id", F.explode(T.cut("text", 1000)).alias("s")).select("doc_id", "s.start", F.col("s.value").alias("chunk"))
    return chunks.where(F.length("chunk") >= 200).select("doc_id", "start", F.length("chunk").cast("long").alias("size"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


def _blocks(rows: DataFrame, block) -> DataFrame:
    return rows.select("doc_id", "feature_pos", X.rounded(block).alias("features"))


@query
def feat_byte_window(spark, d):
    """byte values around each mark."""
    return _blocks(X.context(documents(spark, d), around=("left", "right")), X.byte_window(8, 8))


@query
def feat_encoded_window(spark, d):
    """ordinal codes around each mark."""
    return _blocks(X.context(documents(spark, d), around=("left", "right")), X.encoded_window(4, 4))


@query
def feat_ascii_neighbors(spark, d):
    """classes of both neighbours."""
    return _blocks(X.context(documents(spark, d), around=("left", "right")), X.ascii_neighbours())


@query
def feat_boundary_shape(spark, d):
    """shape of the boundary, its line and the next."""
    return _blocks(X.line_context(structured(spark, d), around=("right", "before", "behind", "breaks_behind"), chars=""), X.boundary_shape())


@query
def feat_line_byte_counts(spark, d):
    """shares of structural characters in the rest of each mark's line."""
    return _blocks(X.line_shares(structured(spark, d)), F.col("line_shares"))


@query
def feat_sentence_kernel(spark, d):
    """the sentence preset of 109 columns."""
    return _blocks(X.line_context(conversations(spark, d)), X.sentence_kernel(tokens=True))


@query
def feat_byte_class_counts(spark, d):
    """Shares of the ten byte classes around each mark."""
    return _blocks(X.context(documents(spark, d), around=("left", "right")), X.class_counts(list(X.BYTE_CLASSES.values()), 16, 16))


@query
def feat_dir_byte_classes(spark, d):
    """shares of byte classes and of Unicode groups on either side."""
    return _blocks(X.context(documents(spark, d), around=("left", "right")), X.class_counts([*[X.BYTE_CLASSES[c] for c in X.COUNTED], *X.UNICODE_GROUPS], 16, 16, True))


@query
def feat_lexicon(spark, d):
    """Encoded window and word look-ups around marks, 17 columns."""
    return _blocks(X.context(documents(spark, d), "[.!?;,:\"')]", around=X.LEXICON_FIELDS[1:], reach=X.LEXICON_REACH), X.lexicon_block())


@query
def feat_terminators(spark, d):
    """What the sentence net looks at, for all terminators."""
    return _blocks(X.context(documents(spark, d), C.TERMINATOR_PATTERN, around=X.TERMINATOR_FIELDS[1:]), X.terminator_block())


@query
def decode_clusters(spark, d):
    """The best mark of each cluster of scored terminators; a mark's cluster reaches over closers behind it."""
    closers = "[" + "".join("\\" + c if c.isascii() else c for c in C.CLOSERS) + "]"

    def scored(m, k):
        v = m["value"]
        score = F.when(v.isin(*".!?…"), 0.75).when(v.isin(*C.CLOSERS), 0.5).otherwise(0.25) + F.when(k % 3 == 0, 0.125).otherwise(0.0)
        resume = m["end_byte"] + F.octet_length(m["rest"]) - F.octet_length(F.ltrim(F.regexp_replace(m["rest"], f"^{closers}+", ""), F.lit(T.BLANKS)))
        return F.struct(m["end_byte"], m["end"], resume, score).cast(D.MARK)

    marks = F.transform(T.locate("text", C.TERMINATOR_PATTERN, ("value", "rest")), scored)
    rows = documents(spark, d).select("doc_id", F.explode(D.best_of_clusters(marks, 0.5)).alias("m"))
    return rows.select("doc_id", "m.break_end", "m.score")


@query
def segment_bundle(spark, d):
    """Sentences by the trained head of the package's bundle over all terminators."""
    head = bundles.load(spark, f"file://{segmenter.DEFAULT_BUNDLE}", segmenter.SENTENCE_ROLE)
    rows = segmenter.bundle_sentences(documents(spark, d), head).select("doc_id", T.each("spans").alias("s"))
    return rows.select("doc_id", "s.start", "s.end")


@query
def train_net(spark, d):
    """A net of two hidden layers for quality and toxicity, trained on all labelled documents, and its scores."""
    docs = documents(spark, d).join(table(spark, d, "labels"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    shares = F.array(*[F.least(F.regexp_count("text", F.lit(p)) * k / n, F.lit(1.0)) for p, k in (("\\p{Lu}", 4), ("[.!?]", 20), ("[^\\p{L}\\p{N}\\s]", 8), ("\\s", 4), ("[0-9]", 8))], F.least(F.ln(n) / 12, F.lit(1.0)))
    rows = docs.select("doc_id", shares.alias("features"), F.array(*[F.col(c).cast("int") for c in ("quality", "toxic")]).alias("targets"))
    fitted = N.fit(rows, (8, 8), epochs=25, rate=0.05, positive=[1.0, 4.0])
    return rows.select("doc_id", N.scores(F.col("features"), fitted.net).alias("s")).select("doc_id", F.col("s")[0].alias("quality"), F.col("s")[1].alias("toxic"))


def _spanned(spark, d) -> DataFrame:
    """Documents with ``spans``: their sentences and lines."""
    span = lambda label: lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("left_open"), F.lit(False).alias("right_open"))
    found = F.concat(F.transform(segmenter._sentence_spans(segmenter.THRESHOLD), span("sentence")), F.transform(T.locate("text", "[^\\n\\r]+"), span("line")))
    return documents(spark, d).select("doc_id", "text", found.alias("spans"))


@query
def sample_label_reservoirs(spark, d):
    """All edges of sentences and lines, 500 positions inside each and 200 inside neither."""
    return P.select_positions(_spanned(spark, d), ["sentence", "line"], 500, 200)


@query
def train_position_heads(spark, d):
    """Hashed sparse features of sampled positions, and what heads for starts and ends of sentences learn from them."""
    heads = packed.train(_spanned(spark, d), ["sentence", "line"], ["start:sentence", "end:sentence"], 2000, 2000, 1 << 12)
    return spark.createDataFrame([(c, len(w), sum(x != 0 for x in w), b) for c, (w, b) in heads.items()], "head string, width int, used int, bias double")


@query
def feat_token_shape(spark, d):
    """shape of the tokens."""
    return _blocks(X.context(documents(spark, d), around=("left", "right", "after", "token", "breaks")), X.token_shape())


@query
def feat_class_counts(spark, d):
    """Shares of classes in the centred window."""
    return _blocks(X.context(documents(spark, d), around=("left", "right")), X.class_counts(["[A-Z]", "[a-z]", "[0-9]", "[ \\t\\n\\r]", "[.!?]"], 16, 16))


@query
def feat_dir_unicode_categories(spark, d):
    """Shares of Unicode categories on either side."""
    return _blocks(X.context(documents(spark, d), around=("left", "right")), X.class_counts(["\\p{Lu}", "\\p{Ll}", "\\p{N}", "\\p{P}", "\\p{S}"], 12, 12, True))


@query
def feat_line_shape(spark, d):
    """line metrics."""
    return L.line_table(structured(spark, d)).select("doc_id", F.col("position").alias("feature_pos"), X.rounded(X.line_shape(), 4).alias("features"))


@query
def feat_line_context(spark, d):
    """Place of a line in its text, and its neighbours."""
    return L.line_table(structured(spark, d)).select("doc_id", F.col("position").alias("feature_pos"), X.rounded(X.line_context_metrics(), 4).alias("features"))


@query
def line_at_position(spark, d):
    """Start, end and text of the line at every 300th byte."""
    docs = structured(spark, d)
    lines = docs.select("doc_id", F.explode(L.line_array("text")).alias("x")).select("doc_id", "x.start_byte", "x.raw")
    found = L.line_of(lines, C.scan_stride(docs, 300))
    return found.select("doc_id", "position", "line_start", "line_end", F.md5(F.col("line").cast("binary")).alias("digest"))


def _scored(spark, d) -> DataFrame:
    return segmenter.score(documents(spark, d))


@query
def score_logistic_fixed(spark, d):
    """M1, M4: fixed logistic scores of all marks."""
    return _scored(spark, d).select("doc_id", "break_end", F.round("score", 6).alias("score"))


@query
def score_softmax_fixed(spark, d):
    """M3: three classes over embeddings with fixed weights."""
    v = table(spark, d, "embeddings").where("embedding is not null")
    p = M.softmax(F.col("embedding"), M.fixed_weights(3, 64), [0.0, 0.125, -0.125])
    return v.select("vec_id", *[F.round(p[k], 5).alias(f"p{k}") for k in range(3)])


@query
def score_mlp_fixed(spark, d):
    """M5, M7: forward pass of a small network over embeddings."""
    v = table(spark, d, "embeddings").where("embedding is not null")
    p = M.mlp(F.col("embedding"), [(M.fixed_weights(4, 64), [0.0] * 4), (M.fixed_weights(2, 4), [0.125, -0.25])])
    return v.select("vec_id", F.round(p[0], 5).alias("a"), F.round(p[1], 5).alias("b"))


@query
def decode_threshold(spark, d):
    """Threshold spans with their tails."""
    docs = documents(spark, d)
    return D.threshold_spans(_scored(spark, d), docs.select("doc_id", F.octet_length("text").cast("long").alias("size")), 0.5)


@query
def decode_argmax(spark, d):
    """The largest component of each embedding."""
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", D.argmax("embedding").alias("best"))


def _line_labels(spark, d) -> DataFrame:
    lines = C.lines(structured(spark, d)).withColumn("label", Q.display_type(F.col("line")))
    score = (F.pmod(F.length("line"), F.lit(10)) + 1) / 10.0
    return lines.select("doc_id", "line_no", F.col("start_byte").alias("position"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), "label", score.alias("score"))


@query
def decode_contiguous(spark, d):
    """Runs of one line type with best and mean score."""
    sizes = structured(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("size"))
    out = D.contiguous_spans(_line_labels(spark, d), sizes)
    return out.withColumns({"score": F.round("score", 6), "mean": F.round("mean", 6)})


@query
def decode_sentence_spans(spark, d):
    """Sentences of all documents as spans in code points."""
    return segmenter.sentences(documents(spark, d), values=False).select("doc_id", "start", "end", "start_byte", "end_byte")


@query
def decode_structure_runs(spark, d):
    """Neighbouring lines of one label above a threshold."""
    return D.line_runs(_line_labels(spark, d), 0.4).withColumn("score", F.round("score", 6))


@query
def decode_asof(spark, d):
    """The last score at or before every 700th byte."""
    scores = _scored(spark, d).select("doc_id", F.col("break_end").alias("position"), "score")
    return D.as_of(C.scan_stride(documents(spark, d), 700), scores).withColumn("score", F.round("score", 6))


@query
def decode_fused(spark, d):
    """Breaks by the fused change of three heads, whose scores stand at every 16th byte."""
    marks = C.spans(documents(spark, d), "[.!?]", around=("rest", "after"), reach=1)
    lead = F.octet_length("rest") - F.octet_length(F.ltrim("rest", F.lit(T.BLANKS)))
    candidates = marks.select("doc_id", F.col("end_byte").alias("end"), F.when(F.length("after") > 0, F.col("end_byte") + lead).alias("next_start"))
    share = lambda a, b: F.pmod(F.col("position") * a, F.lit(b)) / (b - 1.0)
    scores = C.scan_stride(documents(spark, d), 16).select("doc_id", "position", share(7, 11).alias("inside"), share(3, 13).alias("starts"), share(5, 17).alias("ends"))
    return D.fused_breaks(candidates, scores, 0.9).select("doc_id", "end", F.round("score", 6).alias("score"), "selected")


@query
def units_to_spans(spark, d):
    """Neighbouring paragraphs of one display type merged."""
    units = C.paragraphs(conversations(spark, d)).withColumn("label", Q.display_type(F.split("value", "\\n")[0]))
    units = units.withColumn("label", F.when(F.col("label") == "prose", "none").otherwise(F.col("label")))
    return D.unit_spans(units)


def _range_sides(spark, d):
    sentences = segmenter.sentences(documents(spark, d), values=False).select("doc_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    windows = C.scan_stride(documents(spark, d), 256).select("doc_id", F.col("position").alias("start"), (F.col("position") + 256).alias("end"))
    return windows, sentences


@query
def span_overlap_targets(spark, d):
    """How much of each 256-character window its best sentence covers."""
    both = R.range_join(*_range_sides(spark, d))
    best = both.groupBy("doc_id", "start").agg(F.max(R.overlap_ratio()).alias("ratio"), F.count("*").alias("n"))
    return best.select("doc_id", "start", "n", F.round("ratio", 6).alias("ratio"), (F.col("ratio") >= 0.35).alias("target"))


@query
def span_cross_pairs(spark, d):
    """Crossing pairs of windows and sentences by document."""
    both = R.range_join(*_range_sides(spark, d)).where(R.crosses(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")))
    return both.groupBy("doc_id").agg(F.count("*").alias("crossing"))


@query
def span_boundary_targets(spark, d):
    """Candidates that end a sentence that isn't open to the right."""
    cands = C.punctuation_breaks(documents(spark, d), 1).select("doc_id", "break_end")
    gold = segmenter.sentences(documents(spark, d), values=False).withColumn("right_open", F.pmod("end_byte", F.lit(7)) == 0)
    return R.boundary_targets(cands, gold).select("doc_id", "break_end", F.col("target").cast("long").alias("target"))


@query
def render_sentences(spark, d):
    """Texts with sentence tags."""
    docs = documents(spark, d)
    spans = segmenter.sentences(docs, values=False).select("doc_id", F.lit("sentence").alias("label"), "start", "end")
    return R.render(spans, docs).select("doc_id", F.md5(F.col("tagged").cast("binary")).alias("digest"), F.length("tagged").cast("long").alias("size"))


@query
def resolve_crossing(spark, d):
    """Sentences and windows as sections, crossings removed."""
    windows, sentences = _range_sides(spark, d)
    one = F.lit(1.0).alias("score")
    spans = sentences.select("doc_id", F.struct(F.lit("sentence").alias("label"), F.col("r_start").alias("start"), F.col("r_end").alias("end"), one).alias("s"))
    spans = spans.unionAll(windows.select("doc_id", F.struct(F.lit("section").alias("label"), "start", "end", one).alias("s")))
    kept = R.resolve(spans.groupBy("doc_id").agg(F.collect_list("s").alias("spans")))
    return kept.select("doc_id", F.size("spans").cast("long").alias("n"))


@query
def predicate_line_types(spark, d):
    """Q2, Q3: display types of all lines."""
    lines = C.lines(structured(spark, d)).unionByName(C.lines(conversations(spark, d)))
    c = F.col("line")
    flags = [F.count_if(f(c)).alias(n) for n, f in (("section", Q.section_like), ("dialogue", Q.dialogue_like), ("list_item", Q.list_item_like), ("metadata", Q.metadata_like))]
    return lines.groupBy(Q.display_type(c).alias("kind")).agg(F.count("*").alias("n"), *flags)


@query
def quality_segments(spark, d):
    """Q1: documents that pass the quality filter."""
    return documents(spark, d).select("doc_id", Q.quality_ok(F.col("text")).alias("ok"))


@query
def terminal_quotes(spark, d):
    """Q4, Q5: closing terminals and unbalanced quotes of documents."""
    return documents(spark, d).select("doc_id", Q.has_terminal(F.col("text")).alias("terminal"), Q.unbalanced_quotes(F.col("text")).alias("unbalanced"))


@query
def span_quality(spark, d):
    """Q7: sentence spans by what is wrong with them."""
    s = segmenter.sentences(documents(spark, d))
    return s.groupBy(Q.span_quality(F.col("value")).alias("reason")).agg(F.count("*").alias("n"))


@query
def edge_flags(spark, d):
    """Q6: open edges of chunks of 1000 characters."""
    size = F.length("text")
    rows = documents(spark, d).select("doc_id", "text", F.explode(F.when(size > 0, F.sequence(F.lit(0).cast("long"), (size - 1).cast("long"), F.lit(1000).cast("long")))).alias("start"))
    left, right = Q.edge_flags(F.col("text"), F.col("start"), F.least(F.col("start") + 1000, F.length("text")))
    return rows.select("doc_id", "start", left.alias("left_open"), right.alias("right_open"))


@query
def false_boundary_filter(spark, d):
    """Q8: full stops that end no sentence."""
    rows = X.context(documents(spark, d), "[.]", around=("left", "right"))
    return rows.groupBy("doc_id").agg(F.count_if(Q.false_boundary(F.col("left"), F.col("right"))).alias("false_breaks"), F.count("*").alias("n"))


def _judged(spark, d) -> DataFrame:
    """Labels with a deterministic score that follows them loosely."""
    score = (F.pmod(F.col("doc_id") * 37, F.lit(100)) + 40 * F.col("quality")) / 140.0
    return table(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("long").alias("label"), F.col("toxic").cast("long").alias("toxic"), score.alias("score"))


@query
def metric_confusion(spark, d):
    """A1: confusion counts and rates at 0.5."""
    out = A.confusion(_judged(spark, d), 0.5, "toxic")
    return out.select("toxic", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query
def metric_threshold_sweep(spark, d):
    """A2-A4: the sweep of thresholds."""
    return A.sweep(_judged(spark, d)).select("step", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query
def metric_best_threshold(spark, d):
    """A2: best threshold for each toxic flag."""
    best = A.best_threshold(A.sweep(_judged(spark, d), 5, 95, "toxic"), "toxic")
    return best.select("toxic", "step", F.round("f1", 6).alias("f1"))


@query
def metric_boundary_prf(spark, d):
    """Version 1 breaks held against sentences, as sets of bounds."""
    docs = documents(spark, d)
    gold = segmenter.sentences(docs, values=False).select("doc_id", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
    return A.boundary_scores(D.threshold_spans(_scored(spark, d), docs.select("doc_id", F.octet_length("text").cast("long").alias("size")), 0.5), gold).select(
        "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


@query
def metric_macro_by_label(spark, d):
    """F1 by toxic flag and its mean, as grouping sets."""
    per = A.confusion(_judged(spark, d), 0.5, "toxic")
    return per.rollup("toxic").agg(F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("heads")).fillna(-1, ["toxic"])


@query
def metric_parity_diff(spark, d):
    """The first eight differing cells of two encodings, one rounded down and one rounded to the nearest."""
    v = table(spark, d, "embeddings").where("embedding is not null")
    scale = lambda shift: F.transform("embedding", lambda x: F.floor(x.cast("double") * 8 + shift))
    out = A.parity(v.select("vec_id", scale(0.0).alias("f")), v.select("vec_id", scale(0.5).alias("f")), "vec_id", "f", 8)
    return out.select("vec_id", F.col("column").cast("long").alias("column"), "a", "b")


@query
def leaderboard(spark, d):
    """Experiments that weigh a label by 0, 20, 40 and 80 of 140, ranked by best F1 in validation and evaluation."""
    rows = table(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("long").alias("label"), F.explode(F.array(*map(F.lit, (0, 20, 40, 80)))).alias("weight"))
    score = (F.pmod(F.col("doc_id") * 37, F.lit(100)) + F.col("weight") * F.col("label")) / 200.0
    part = F.when(F.pmod("doc_id", F.lit(5)) == 4, "validation").otherwise("evaluation")
    out = A.leaderboard(rows.select(F.concat(F.lit("w"), F.col("weight").cast("string")).alias("experiment"), part.alias("part"), "label", score.alias("score")))
    return out.select("experiment", "rank", "step", F.round("validation_f1", 6).alias("validation_f1"), F.round("evaluation_f1", 6).alias("evaluation_f1"))


@query
def stats_corpus(spark, d):
    """A10: counts by language and source."""
    return documents(spark, d).groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("texts"))


@query
def sample_hash_negatives(spark, d):
    """All sentence ends and a hashed tenth of the other marks (a third of ``.!?``)."""
    gold = segmenter.sentences(documents(spark, d), values=False).select("doc_id", F.col("end_byte").alias("break_end"), F.lit(1).alias("label")).distinct()
    marks = C.spans(documents(spark, d), "[.!?;,]").select("doc_id", F.col("start_byte").alias("feature_pos"), F.col("end_byte").alias("break_end"), "value")
    rows = marks.join(gold, ["doc_id", "break_end"], "left").fillna(0, ["label"])
    return S.keep_hashed_negatives(rows, 0.1, 0.33).select("doc_id", "feature_pos", F.col("label").cast("long").alias("label"))


@query
def sample_stratified_cap(spark, d):
    """Twenty documents of each language by least draw."""
    return S.stratified(documents(spark, d).select("doc_id", "lang"), "doc_id", "lang", 20)


@query
def split_prefix(spark, d):
    """The first eight tenths of the documents."""
    return S.prefix_split(documents(spark, d).select("doc_id"), "doc_id", 8, 10)


@query
def split_fifth_alternating(spark, d):
    """Every fifth id to validation, even ids to tuning."""
    return documents(spark, d).select("doc_id", (F.pmod("doc_id", F.lit(5)) == 4).alias("validation"), (F.pmod("doc_id", F.lit(2)) == 0).alias("tuning"))


@query
def repeat_positives(spark, d):
    """Toxic rows three times."""
    rows = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    return S.repeat_positives(rows, F.when(F.col("toxic") == 1, 3).otherwise(1)).withColumn("copy", F.col("copy").cast("long"))


@query
def segment_documents(spark, d):
    """Sentences and structure of documents as one row a document."""
    return segmenter.annotate(structured(spark, d)).select("doc_id", F.size("spans").cast("long").alias("spans"), F.length("tagged").cast("long").alias("size"))


@query
def segment_spans(spark, d):
    """The spans themselves."""
    return segmenter.annotate(structured(spark, d)).select("doc_id", T.each("spans").alias("s")).select("doc_id", "s.label", "s.start", "s.end")


def _with_sentences(spark, d) -> DataFrame:
    docs = documents(spark, d)
    spans = F.transform(segmenter._sentence_spans(segmenter.THRESHOLD), lambda s: F.struct(F.lit("sentence").alias("label"), s["start"].alias("start"), s["end"].alias("end")))
    return docs.where("doc_id is not null").select("doc_id", "text", T.once(spans).alias("spans")).where(F.size("spans") > 0)


@query
def render_checked(spark, d):
    """anyone's spans checked, crossings left out, rendered: sentences, and sections that cross them."""
    docs = _with_sentences(spark, d)
    crossing = F.array(F.struct(F.lit("section").alias("label"), (F.col("spans")[0]["start"] + 1).alias("start"), (F.col("spans")[1]["start"] + 1).alias("end")))
    docs = docs.withColumn("spans", F.array_sort("spans")).withColumn("spans", F.when(F.size("spans") > 1, F.concat("spans", crossing)).otherwise(F.col("spans")))
    return R.render_checked(docs).select("doc_id", F.md5(F.col("tagged").cast("binary")).alias("digest"))


@query
def render_strict(spark, d):
    """Sentences rendered by the renderer that takes no crossing or empty span."""
    return _with_sentences(spark, d).select("doc_id", F.md5(R.strict_text(F.col("text"), F.col("spans")).cast("binary")).alias("digest"))


@query
def cand_sampled_positions(spark, d):
    """A hundred positions of each text, all sentence ends among them."""
    edges = F.transform(segmenter._sentence_spans(segmenter.THRESHOLD), lambda s: s["end_byte"])
    return C.sampled_positions(documents(spark, d), edges, 100)


@query
def cand_from_breaks(spark, d):
    """The character that stands for a break at each paragraph's end."""
    docs = conversations(spark, d)
    return C.from_break_ends(docs, C.paragraph_breaks(docs))


@query
def blocks_logical(spark, d):
    """Lines that belong together."""
    return C.blocks(structured(spark, d)).select("doc_id", "block", "start", "end", F.md5(F.col("value").cast("binary")).alias("digest"))


@query
def paragraphs_prose(spark, d):
    """Paragraphs of prose of conversations."""
    return C.prose_paragraphs(conversations(spark, d), 40, 4000).select("doc_id", "k", "start", "end")


@query
def blocks_eligible(spark, d):
    """Q4: paragraphs of conversations that may hold sentences, and whether they end with a mark."""
    rows = C.paragraphs(conversations(spark, d)).withColumn("label", F.when(F.pmod("k", F.lit(4)) == 3, "section").otherwise("paragraph"))
    return rows.select("doc_id", "k", Q.sentence_eligible(F.col("value"), F.col("label"), 40, 20).alias("eligible"), Q.block_has_terminal(F.col("value")).alias("terminal"))


@query
def eligible_outputs(spark, d):
    """Which outputs of a candidate count in training."""
    docs = conversations(spark, d)
    rows = C.spans(docs, "[.!?…;,][\"')\\]}”’]*", around=("value", "breaks", "right"))
    sentence, paragraph = Q.eligible_outputs(F.col("value"), F.lit(True), F.length("right") == 0, F.col("breaks"), F.pmod("end", F.lit(11)) == 0, F.lit(False))
    return rows.select("doc_id", F.col("end_byte").alias("break_end"), sentence.alias("sentence"), paragraph.alias("paragraph"))


@query
def score_matrix(spark, d):
    """Two heads over one extraction."""
    p = Pipeline().with_block("neighbours", X.ascii_neighbours).with_head("a", [0.5, -1.0, 0.25, 2.0, -0.5, -1.5], 0.125).with_head("b", [0.0, 1.0, 1.0, -1.0, 0.5, 0.25], -0.5)
    return p.score_matrix(documents(spark, d)).select("doc_id", "break_end", F.round(F.col("scores")[0], 6).alias("a"), F.round(F.col("scores")[1], 6).alias("b"))


@query
def feat_compiled_kernel(spark, d):
    """A kernel compiled from its specification."""
    spec = """[{"kind": "byte_window", "left": 2, "right": 2}, {"kind": "ascii_class"}, {"kind": "directional_byte_class_counts", "left": 16, "right": 16, "classes": ["upper", "lower", "digit", "space", "punctuation", "line_break", "open_bracket", "close_bracket"]},
      {"kind": "boundary_shape"}, {"kind": "line_byte_counts"}]"""
    kernel = K.compile_kernel(spec)
    return _blocks(kernel.extract(conversations(spark, d)), F.col("features"))


@query
def sample_segments(spark, d):
    """X11: a hashed piece of each text, its ends at white space."""
    found = S.segments(documents(spark, d), 200, 600)
    return found.select("doc_id", "start", "end", F.md5(F.col("value").cast("binary")).alias("digest"))


@query
def focus_labels(spark, d):
    """Labels in turn and by hash."""
    rows = documents(spark, d).select("doc_id")
    turn = S.focus_labels(rows, list(R.PRIORITY)).select("doc_id", F.lit("turn").alias("strategy"), "focus")
    return turn.unionAll(S.focus_labels(rows, list(R.PRIORITY), "random", seed=5).select("doc_id", F.lit("random").alias("strategy"), "focus"))


@query
def point_contexts(spark, d):
    """What stands around the middle byte of each text."""
    rows = documents(spark, d).where(F.octet_length("text") > 0)
    return rows.select("doc_id", F.md5(T.point_context("text", T.char_boundary("text", F.floor(F.octet_length("text") / 2)), 24).cast("binary")).alias("digest"))


@query
def trimmed_chunks(spark, d):
    """Chunks of 300 characters without the blanks at both ends."""
    rows = documents(spark, d).select("doc_id", F.explode(T.cut("text", 300)).alias("s")).select("doc_id", F.col("s.start").alias("at"), "s.value")
    span = T.trimmed_span("value", F.lit(0).cast("long"), F.length("value"))
    return rows.select("doc_id", "at", span.alias("s")).select("doc_id", "at", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"))


@query
def page_texts(spark, d):
    """Texts of pages of more than 1500 characters, tags gone."""
    found = pages.page_texts(table(spark, d, "pages"))
    return found.select("page_id", F.length("body").cast("long").alias("size"), F.md5(F.col("body").cast("binary")).alias("digest"))


@query
def passages_joined(spark, d):
    """Passages of conversations joined by a blank line, long ones cut."""
    found = pages.join_passages(table(spark, d, "conversations"), "conv_id", "turn", least=300, most=2000)
    return found.select("conv_id", F.length("body").cast("long").alias("size"), F.md5(F.col("body").cast("binary")).alias("digest"))


@query
def book_bodies(spark, d):
    """Middles of books between two marked lines, front matter skipped."""
    text = F.concat(F.lit("Preface\n*** START OF THE BOOK ***\n"), F.coalesce("text", F.lit("")), F.lit("\n*** END OF THE BOOK ***\n"))
    body = pages.without_front_matter(text, r"\*\*\* START OF THE .*? \*\*\*", r"\*\*\* END OF THE ", 2000)
    return documents(spark, d).select("doc_id", body.alias("body")).where("body is not null").select("doc_id", F.length("body").cast("long").alias("size"), F.md5(F.col("body").cast("binary")).alias("digest"))


@query
def train_logistic(spark, d):
    """A quality model fitted on labelled documents by Spark ML."""
    docs = documents(spark, d).join(table(spark, d, "labels").where("quality is not null"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    shares = F.array(*[F.regexp_count("text", F.lit(p)) / n for p in ("\\p{Lu}", "[.!?]", "[^\\p{L}\\p{N}\\s]", "\\s", "[0-9]")])
    rows = docs.select("doc_id", F.col("quality").alias("label"), shares.alias("features"))
    weights, bias = M.fit_logistic(rows)
    return rows.select("doc_id", F.col("label").cast("long").alias("label"), M.logistic(F.col("features"), weights, bias).alias("score"))


@query
def train_heads(spark, d):
    """Independent heads for quality and toxicity, and a constant one."""
    docs = documents(spark, d).join(table(spark, d, "labels").where("quality is not null"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    shares = F.array(*[T.class_count(F.col("text"), p) / n for p in ("\\p{Lu}", "[.!?]", "[^\\p{L}\\p{N}\\s]", "\\s", "[0-9]")])
    rows = docs.select("doc_id", "quality", "toxic", F.lit(0).alias("none"), shares.alias("features"))
    heads = M.fit_heads(rows, ["quality", "toxic", "none"])
    return rows.select("doc_id", *[M.logistic(F.col("features"), *heads[c]).alias(c) for c in heads])


@query
def silver_labels(spark, d):
    """Training sentences joined over full stops that end none."""
    return segmenter.silver_labels(documents(spark, d)).select("doc_id", T.each("spans").alias("s")).select("doc_id", "s.*")


@query
def cand_weak_label(spark, d):
    """Breaks for weak labels with their markers."""
    return C.weak_breaks(documents(spark, d), Q.ABBREVIATIONS).select("doc_id", "break_char", "break_end", F.md5(F.col("marker").cast("binary")).alias("digest"))


@query
def windows_line(spark, d):
    """Runs of lines around list items and metadata lines."""
    lines = C.lines(structured(spark, d))
    anchors = lines.where(Q.display_type(F.col("line")).isin("list", "metadata")).select("doc_id", "line_no")
    return C.line_windows(lines, anchors, most=4000)


@query
def blocks_list_item(spark, d):
    """List items of whole texts with their indented lines, in bytes."""
    head = F.concat(F.lit("- one "), F.coalesce("source", F.lit("")), F.lit("\n  more of one\n\n\tno longer\n2. two\n   of two\n"), F.coalesce("text", F.lit("")))
    docs = documents(spark, d).select("doc_id", head.alias("text"))
    rows = docs.select("doc_id", F.posexplode(L.line_array("text")).alias("line_no", "x"))
    return C.list_blocks(rows.select("doc_id", "line_no", F.col("x.raw").alias("raw"), F.col("x.start_byte").alias("start"), (F.col("x.start_byte") + F.octet_length("x.raw")).alias("end")))


@query
def feat_line_edges(spark, d):
    """first and last characters of lines."""
    return C.lines(structured(spark, d)).select("doc_id", F.col("start_byte").alias("feature_pos"), X.rounded(X.line_edges(12, 6)).alias("features"))


@query
def feat_ngram_hash(spark, d):
    """hashed n-grams of lines."""
    found = X.ngram_hashes(C.lines(structured(spark, d)))
    return found.select("doc_id", "feature_pos", X.rounded(F.col("features")).alias("features"))


@query
def decode_structure_loose(spark, d):
    """The trainer's merge of structure lines."""
    return D.line_runs_loose(_line_labels(spark, d), 0.4, 200, 10).withColumn("score", F.round("score", 6))


@query
def breaks_to_sentences(spark, d):
    """Paragraphs of conversations cut at version 1 breaks."""
    conv = conversations(spark, d)
    ends = C.spans(conv, "[.!?]", around=("right",), reach=1).where(F.col("right").rlike("^[ \\n]")).select("doc_id", F.col("end").alias("break_char"))
    return D.breaks_within(C.paragraphs(conv).select("doc_id", "k", "start", "end"), ends)


@query
def span_inside_start_end(spark, d):
    """Every 97th position inside, at the start or behind the end of sentences with some open edges."""
    sentences = segmenter.sentences(documents(spark, d), values=False).select("doc_id", "start", "end", (F.pmod("start", F.lit(3)) == 0).alias("left_open"), (F.pmod("end", F.lit(3)) == 0).alias("right_open"))
    places = documents(spark, d).select("doc_id", F.explode(F.when(F.length("text") > 0, F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1, F.lit(97).cast("long")))).alias("position"))
    return R.position_targets(places, sentences).select("doc_id", "position", *[F.col(c).cast("long").alias(c) for c in ("inside", "starts", "ends")])


@query
def gold_sentence_ends(spark, d):
    """Distinct ends of sentences and their number by document."""
    ends = segmenter.sentences(documents(spark, d), values=False).select("doc_id", "end_byte").distinct()
    return ends.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end_byte").alias("last"))


@query
def metric_marker_breaks(spark, d):
    """Breaks found in benchmark items against marked ones (the text up to each full stop and line break)."""
    cases = table(spark, d, "benchmark").where("text is not null").select(F.col("item_id").alias("id"), "text", F.regexp_extract("text", "([^.;]{3,12}[.])[ \\n]", 1).alias("gold_marker"))
    found = segmenter.sentences(cases.withColumnRenamed("id", "doc_id")).select(F.col("doc_id").alias("id"), "end")
    return A.break_report(cases, A.internal_breaks(found), A.marker_breaks(cases))


@query
def class_weights(spark, d):
    """Balanced weights of the quality classes."""
    rows = table(spark, d, "labels").where("quality is not null").select(F.col("quality").cast("long").alias("label"))
    return M.class_weights(rows).select("label", "n", F.round("weight", 6).alias("weight"))


@query
def split_three_way(spark, d):
    """Hashed split to fit, calibration and validation, counted by language."""
    u = S.draw(F.col("doc_id"), F.lit(11))
    part = F.when(u < 0.7, "fit").when(u < 0.85, "calibration").otherwise("validation")
    return documents(spark, d).groupBy("lang", part.alias("part")).agg(F.count("*").alias("n"))


@query
def parse_tagged_roundtrip(spark, d):
    """Tagged sentences parsed back."""
    docs = documents(spark, d)
    spans = segmenter.sentences(docs, values=False).select("doc_id", F.lit("sentence").alias("label"), "start", "end")
    parsed = R.parse_tagged(R.render(spans, docs))
    return parsed.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("spans").cast("long").alias("spans"), F.col("error").isNull().alias("ok"))


@query
def chunks_lines(spark, d):
    """Chunks of whole lines, 1500 characters at most."""
    return C.chunks(documents(spark, d), 1500).select("doc_id", "chunk", "start", F.length("value").cast("long").alias("size"))


@query
def pipeline_run(spark, d):
    """A built pipeline over two feature blocks with fixed weights."""
    p = Pipeline().with_block("neighbours", X.ascii_neighbours).with_block("token", X.token_shape).with_model([0.0, 0.0, 0.5, 3.0, -1.0, -2.0, -4.0, *[0.0] * 7, 0.5, -2.5, 0.0, -2.0], -1.0)
    return p.run(documents(spark, d))


@query
def generated_corpus(spark, d):
    """Generated training texts, sentences that the segmenter finds in them."""
    made = generate.generate(spark, 2000, 7)
    found = segmenter.sentences(made.select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.col("end").alias("break_char"))
    gold = made.select(F.col("doc_id").alias("id"), T.each("spans").alias("s")).select("id", F.col("s.end").alias("break_char"))
    return A.break_report(made, found, gold)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence spans of all documents."""
    return segmenter.sentences(documents(spark, sf_dir), values=False).select("doc_id", "start", "end", "start_byte", "end_byte")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.build()
