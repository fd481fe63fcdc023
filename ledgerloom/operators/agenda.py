"""The agenda profile: claim gates, alignment of questions, gaps, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_tokens, quote_in, stable_id, strip, unsupported_numbers
from ..plans.rounds import written
from .graph import mistyped

#: Sentence ends that a report sentence may hold once.
ENDS = "[。！？]"
ANSWERS = 12
#: Beginnings by which a statement names its source, what is put before one without, what counts as naming it.
NAMED = ("公司披露", "半年报披露", "公告披露", "来源称", "报告称")
BY_ISSUER, BY_OTHERS = "公司披露：", "来源称："
ATTRIBUTION = "披露|公司称|报告称|公告称|半年报|年报"
MODES = ("fact", "analysis", "valuation")


def claim_reason(company: str) -> Column:
    """C14: why a proposed claim (entity, statement, quote, period, text) is rejected; null if it is admitted."""
    foreign = (F.col("entity") != company) & ~F.col("quote").contains(F.col("entity")) & ~F.col("statement").contains(F.col("entity"))
    return F.when(~quote_in("quote", "text"), "quote not in source").when(F.size(unsupported_numbers("statement", "quote", F.coalesce("period", F.lit("")))) > 0, "unsupported number").when(foreign, "entity not mentioned")


def analysis_reason(attribution: str) -> Column:
    """C17: why an analysis (premises, allowed, attributed flags, statement, premise_text) is rejected; null if it stands."""
    few = F.size(F.array_distinct("premises")) < 2
    outside = F.size(F.array_except("premises", "allowed")) > 0
    numbers = F.size(unsupported_numbers("statement", "premise_text", F.lit(""))) > 0
    unnamed = F.exists("attributed", lambda a: a) & ~F.col("statement").rlike(attribution)
    return F.when(few, "fewer than two premises").when(outside, "unknown premise").when(numbers, "unsupported number").when(unnamed, "attribution missing")


def sentence_ok(text: Column | str, cited: Column | str, allowed: Column | str) -> Column:
    """At most one sentence, citing only what is allowed."""
    return (F.regexp_count(text, F.lit(ENDS)) <= 1) & (F.size(F.array_except(cited, allowed)) == 0)


def align(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions (question_id, answer_mode) with answers (question_id, id, place, sufficient): n_answers and status."""
    first = F.row_number().over(Window.partitionBy("question_id").orderBy("place", "id"))
    n = answers.withColumn("n", first).where(F.col("n") <= ANSWERS).groupBy("question_id").agg(F.count(F.lit(1)).alias("n_answers"), F.bool_or("sufficient").alias("sufficient"))
    joined = questions.join(n, "question_id", "left")
    some = F.coalesce("n_answers", F.lit(0)) > 0
    status = F.when(some & (F.col("answer_mode") == "fact") & F.coalesce("sufficient", F.lit(False)), "answered").when(some, "partial").otherwise("unanswered")
    return joined.select("question_id", "answer_mode", F.coalesce("n_answers", F.lit(0)).alias("n_answers"), status.alias("status"))


def gaps(questions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Unanswered or partly answered questions and conflicts: kind, ref, place (required first, unanswered first)."""
    open_ = questions.where("status <> 'answered'").select(F.lit("question").alias("kind"), F.col("question_id").cast("string").alias("ref"), F.when(F.col("priority") == "required", 0).otherwise(1).alias("a"), F.when(F.col("status") == "unanswered", 0).otherwise(1).alias("b"))
    return open_.unionByName(conflicts.select(F.lit("conflict").alias("kind"), F.col("ref").cast("string").alias("ref"), F.lit(2).alias("a"), F.lit(0).alias("b")))


def augment(questions: DataFrame, proposed: DataFrame, most: int = 2) -> DataFrame:
    """The first proposed questions per section whose text is new."""
    new = proposed.join(questions.select("section_id", "text"), ["section_id", "text"], "left_anti").dropDuplicates(["section_id", "text"])
    n = F.row_number().over(Window.partitionBy("section_id").orderBy("seq", "text"))
    return new.withColumn("n", n).where(F.col("n") <= most).drop("n")


def sentences(spans: DataFrame, evidence: DataFrame) -> DataFrame:
    """C20: report sentences (section_id, seq, text, claims) with the sorted distinct evidence of their claims as references."""
    each = spans.select("section_id", "seq", "text", F.explode_outer("claims").alias("claim_id"))
    refs = each.join(evidence.select("claim_id", "evidence_id"), "claim_id", "left").groupBy("section_id", "seq", "text").agg(F.array_sort(F.collect_set("evidence_id")).alias("refs"))
    return refs.withColumn("rendered", F.concat("text", F.array_join(F.transform("refs", lambda r: F.concat(F.lit("["), r.cast("string"), F.lit("]"))), "")))


def gap_hits(hits: DataFrame, seen: DataFrame, domains: list[str], as_of: str, per_query: int = 3, most: int = 4) -> DataFrame:
    """Landed search hits (query, place, url): PDFs of official domains dated by as_of, not seen; capped per query and in all."""
    host = F.parse_url("url", F.lit("HOST"))
    official = F.lit(False)
    for d in domains:
        official = official | (host == d) | host.endswith("." + d)
    fit = hits.where(F.lower("url").endswith(".pdf") & official & (F.try_to_date(F.regexp_extract("url", r"/(20\d\d-\d\d-\d\d)/", 1)) <= F.lit(as_of).cast("date")))
    fresh = fit.join(seen.select("url"), "url", "left_anti")
    n = F.row_number().over(Window.partitionBy("query").orderBy("place", "url"))
    return fresh.withColumn("n", n).where(F.col("n") <= per_query).drop("n").groupBy("url").agg(F.min("place").alias("place"), F.min("query").alias("query")).orderBy("query", "place", "url").limit(most)


def listed(entities: DataFrame, as_of: str) -> DataFrame:
    """Entities (id, listed_on); an error if one wasn't listed by the day as_of."""
    early = F.coalesce(F.col("listed_on") <= F.lit(as_of).cast("date"), F.lit(False))
    name = F.when(early, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("not listed by then: "), F.coalesce(F.col("id").cast("string"), F.lit("?"))))).alias("id")
    return entities.select(name, *[c for c in entities.columns if c != "id"])


def graph_errors(nodes: DataFrame, edges: DataFrame, held: DataFrame) -> DataFrame:
    """(code, id) of mistyped edges, reportable propositions that don't hold, and spans without claims that all hold.

    nodes: id, node_type, status; held: ids that `graph.reportable` gives.
    """
    typed = mistyped(nodes, edges).select(F.lit("edge type").alias("code"), F.concat_ws(" ", "source_id", "edge_type", "target_id").alias("id"))
    loose = nodes.where("node_type = 'Proposition' and status = 'reportable'").join(held, "id", "left_anti").select(F.lit("not traceable"), "id")
    spans = nodes.where("node_type = 'ReportSpan'").select("id")
    says = edges.where("edge_type = 'EXPRESSES'").select(F.col("source_id").alias("id"), F.col("target_id").alias("claim_id"))
    mute = spans.join(says, "id", "left_anti").select(F.lit("span without claim"), "id")
    wrong = spans.join(says, "id").join(held.select(F.col("id").alias("claim_id")), "claim_id", "left_anti").select(F.lit("span of a claim that does not hold"), "id").distinct()
    return typed.union(loose).union(mute).union(wrong)


def report_lines(sections: DataFrame, spoken: DataFrame, citations: DataFrame) -> DataFrame:
    """Markdown lines (part, place, seq, line) of a report: titles, sentences with references, then the citations.

    sections: section_id, title, place; spoken: what `sentences` gives; citations: evidence_id, title, url, quote. Only
    evidence that a sentence refers to is listed. Sorting by (part, place, seq) gives the document.
    """
    titles = sections.select(F.lit(1).alias("part"), F.col("place").cast("long").alias("place"), F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("## "), F.col("title")).alias("line"))
    body = spoken.join(sections.select("section_id", "place"), "section_id").select(F.lit(1), F.col("place").cast("long"), F.col("seq").cast("long"), F.col("rendered"))
    used = spoken.select(F.explode("refs").alias("evidence_id")).distinct()
    listing = F.concat_ws(" ", F.concat(F.lit("["), F.col("evidence_id").cast("string"), F.lit("]")), "title", "url", "quote")
    tail = citations.join(used, "evidence_id", "left_semi").select(F.lit(2), F.lit(0).cast("long"), F.col("evidence_id").cast("long"), listing)
    return titles.union(body).union(tail)


def question_facts(scores: DataFrame, most: int = 16) -> DataFrame:
    """Per question the first facts: priority ones, then by score (0 as well), documents before records, newest first.

    scores: question_id, id, priority, score, is_document, period_end.
    """
    order = (F.desc("priority"), F.desc("score"), F.desc("is_document"), F.desc("period_end"), "id")
    n = F.row_number().over(Window.partitionBy("question_id").orderBy(*order))
    return scores.withColumn("rank", n).where(F.col("rank") <= most)


def call_totals(calls: DataFrame) -> DataFrame:
    """Calls, seconds and tokens by stage of the calls of all runs (stage, seconds, tokens); null counts as nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.groupBy("stage").agg(F.count(F.lit(1)).alias("calls"), total("seconds"), total("tokens"))


def seeded(plans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plans (plan_id, sections) as (sections, questions, errors); a plan with an error gives neither sections nor questions.

    sections: array of title, purpose, questions (array of text, priority, answer_mode, search_terms). A plan needs 3 to 10
    sections, each with a title and a list of questions, and a question at all; errors: plan_id, error, the first of these.
    Questions without a text or of an unknown mode are left out; priority is required or optional; blank search terms go,
    and a question without any is its own. Ids follow plan, section, question place.
    """
    n = F.coalesce(F.size("sections"), F.lit(0))
    title = lambda s: strip(F.coalesce(s["title"], F.lit(""))) == ""
    usable = lambda q: q.isNotNull() & (F.coalesce(q["text"], F.lit("")) != "") & F.coalesce(q["answer_mode"].isin(*MODES), F.lit(False))
    total = F.aggregate("sections", F.lit(0), lambda a, s: a + F.size(F.filter(s["questions"], usable)))
    error = F.when(~n.between(3, 10), "not 3 to 10 sections").when(F.exists("sections", lambda s: s.isNull() | title(s)), "section without a title").when(F.exists("sections", lambda s: s["questions"].isNull()), "section without questions").when(total == 0, "no question")
    marked = plans.select("plan_id", "sections", error.alias("error"))
    good = marked.where("error is null").select("plan_id", F.posexplode("sections").alias("order", "s"))
    section_id = stable_id("SEC", "plan_id", "order")
    sections = good.select("plan_id", section_id.alias("section_id"), "s.title", F.coalesce("s.purpose", F.lit("")).alias("purpose"), "order")
    asked = good.select("plan_id", section_id.alias("section_id"), "order", F.posexplode("s.questions").alias("place", "q")).where(usable(F.col("q")))
    terms = F.filter(F.transform("q.search_terms", strip), lambda t: t != "")
    terms = F.when(F.coalesce(F.size(terms), F.lit(0)) > 0, terms).otherwise(F.array("q.text"))
    priority = F.when(F.col("q.priority") == "required", "required").otherwise("optional")
    questions = asked.select("plan_id", "section_id", stable_id("Q", "plan_id", "order", "place").alias("question_id"), "order", "place", "q.text", priority.alias("priority"), "q.answer_mode", terms.alias("search_terms"), F.lit("unanswered").alias("status"))
    return sections, questions, marked.where("error is not null").select("plan_id", "error")


def document_claims(claims: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C14: proposed claims as (propositions, grounds, rejected).

    claims: chunk_id, seq, quote, statement, entity_name, period_end; chunks: chunk_id, company, text, source_role. A
    statement that doesn't name its source gets the source's name in front. propositions: one for each entity, statement and
    period, the first by seq; grounds: id, evidence_id, chunk_id, quote, a row for each claim admitted; rejected: chunk_id,
    seq, reason: unknown chunk, quote not in source, statement or entity missing, unsupported number, entity not mentioned.
    """
    blank = lambda c: strip(F.coalesce(c, F.lit("")))
    rows = claims.join(chunks.select("chunk_id", "company", "text", "source_role", F.lit(True).alias("known")), "chunk_id", "left")
    rows = rows.withColumns({"quote": blank("quote"), "statement": blank("statement"), "entity": blank("entity_name"), "period": F.coalesce("period_end", F.lit(""))})
    named = F.lit(False)
    for start in NAMED:
        named = named | F.col("statement").startswith(start)
    ahead = F.when(F.col("source_role") == "issuer_disclosure", BY_ISSUER).otherwise(BY_OTHERS)
    rows = rows.withColumn("bare", F.col("statement") == "").withColumn("statement", F.when(named, F.col("statement")).otherwise(F.concat(ahead, "statement")))
    foreign = ~F.col("entity").eqNullSafe(F.col("company")) & ~F.col("quote").contains(F.col("entity")) & ~F.col("statement").contains(F.col("entity"))
    reason = (
        F.when(F.col("known").isNull(), "unknown chunk").when(~F.coalesce(quote_in("quote", "text"), F.lit(False)), "quote not in source").when(F.col("bare") | (F.col("entity") == ""), "statement or entity missing")
        .when(F.size(unsupported_numbers("statement", "quote", "period")) > 0, "unsupported number").when(foreign, "entity not mentioned")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").withColumn("id", stable_id("P", "entity", "statement", F.lit("attributed"), "period")).withColumn("evidence_id", stable_id("E", "chunk_id", "quote", "seq"))
    rest = F.struct("entity", "statement", F.nullif("period", F.lit("")).alias("period_end"))
    props = good.groupBy("id").agg(F.min_by(rest, F.struct("seq", "chunk_id")).alias("x")).select("id", F.lit("attributed").alias("kind"), F.lit("reportable").alias("status"), "x.*")
    return props, good.select("id", "evidence_id", "chunk_id", "quote"), rows.where("reason is not null").select("chunk_id", "seq", "reason")


def _rejoined(rows: DataFrame, key: list[str], given: str, known: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates over the distinct ids in an array column, each looked up in known (key, id, ...); ids and unknown count them."""
    each = rows.select(*key, F.explode_outer(F.array_distinct(given)).alias("id"))
    found = each.join(known.withColumn("found", F.lit(1)), [*(k for k in key if k in known.columns), "id"], "left")
    return found.groupBy(*key).agg(F.count("id").alias("ids"), F.count_if(F.col("id").isNotNull() & F.col("found").isNull()).alias("unknown"), *aggregates)


def _numbers(*texts: Column) -> Column:
    """The distinct numbers of all texts of a group, pre-aggregated: as many as its few premises hold."""
    return F.array_distinct(F.flatten(F.collect_set(number_tokens(F.concat_ws(" ", *texts)))))


def analyses(proposals: DataFrame, premises: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C17: proposed conclusions as (propositions, edges, rejected).

    proposals: proposal_id, question_id, statement, premise_ids, warrant; premises: question_id, id, statement, kind (those a
    question offers, eight at most); verdicts: proposal_id, verdict. A conclusion needs a known question, two premises or
    more, all of them offered, a statement, a warrant, no number that its premises lack, and to name the source if a premise
    is attributed; else it is rejected with the first reason. Without the verdict accepted it stays a candidate. edges:
    PREMISE_OF for every premise, ANSWERS for accepted ones; rejected: proposal_id, reason.
    """
    rows = proposals.withColumn("statement", strip(F.coalesce("statement", F.lit("")))).withColumn("warrant", strip(F.coalesce("warrant", F.lit(""))))
    own = premises.select("question_id", "id", F.col("statement").alias("said"), "kind")
    seen = _rejoined(rows, ["proposal_id", "question_id"], "premise_ids", own, _numbers(F.col("said")).alias("numbers"), F.bool_or(F.col("kind") == "attributed").alias("attributed"))
    known = premises.select("question_id").distinct().withColumn("asked", F.lit(True))
    full = rows.join(seen.drop("question_id"), "proposal_id", "left").join(known, "question_id", "left")
    fresh = F.size(F.array_except(number_tokens("statement"), F.col("numbers"))) > 0
    mute = F.coalesce("attributed", F.lit(False)) & ~F.col("statement").rlike(ATTRIBUTION)
    reason = F.when(F.col("asked").isNull(), "unknown question").when(F.col("ids") < 2, "fewer than two premises").when(F.col("unknown") > 0, "unknown premise").when((F.col("statement") == "") | (F.col("warrant") == ""), "statement or warrant missing").when(fresh, "unsupported number").when(mute, "attribution missing")
    judged = full.select("proposal_id", "question_id", "statement", "warrant", "premise_ids", reason.alias("reason"))
    told = written(judged.join(verdicts.select("proposal_id", "verdict"), "proposal_id", "left"), "analyses")  # each output reads it
    accepted = F.coalesce(F.col("verdict") == "accepted", F.lit(False))
    good = told.where("reason is null").withColumn("id", stable_id("P", F.lit("analysis"), "question_id", "proposal_id"))
    props = good.select("id", "proposal_id", "question_id", F.lit("analysis").alias("kind"), F.when(accepted, "reportable").otherwise("candidate").alias("status"), "statement", "warrant", F.coalesce("verdict", F.lit("unreviewed")).alias("review"))
    links = good.select(F.explode(F.array_distinct("premise_ids")).alias("source_id"), F.lit("PREMISE_OF").alias("edge_type"), F.col("id").alias("target_id"))
    links = links.union(good.where(accepted).select("id", F.lit("ANSWERS"), F.col("question_id")))
    return props, links, told.where("reason is not null").select("proposal_id", "reason")


def reviewed_sentences(sentences: DataFrame, claims: DataFrame, verdicts: DataFrame, licensed: str = "") -> DataFrame:
    """C20: sentences with the first reason to reject them (null: they are printed).

    sentences: section_id, seq, text, claim_ids; claims: section_id, id, statement, kind, display, period_end (those that a
    section may state); verdicts: section_id, seq, accepted. A sentence needs a text of one sentence at most, claims of its
    section alone, the source's name if a claim is attributed, no number but those of its claims and of `licensed` (ticker
    and date), and a review that accepts it.
    """
    key = ["section_id", "seq"]
    rows = sentences.withColumn("text", strip(F.coalesce("text", F.lit(""))))
    said = claims.select("section_id", "id", "statement", "kind", F.coalesce("display", F.lit("")).alias("display"), F.coalesce(F.col("period_end").cast("string"), F.lit("")).alias("period"))
    seen = _rejoined(rows, key, "claim_ids", said, _numbers(F.col("statement"), F.col("display"), F.col("period")).alias("numbers"), F.bool_or(F.col("kind") == "attributed").alias("attributed"))
    full = rows.join(seen, key, "left").join(verdicts.select(*key, "accepted"), key, "left")
    loose = (F.col("text") == "") | (F.col("ids") == 0) | (F.col("unknown") > 0) | (F.regexp_count("text", F.lit(ENDS)) > 1)
    mute = F.coalesce("attributed", F.lit(False)) & ~F.col("text").rlike(ATTRIBUTION)
    fresh = F.size(F.array_except(F.array_except(number_tokens("text"), F.col("numbers")), number_tokens(F.lit(licensed)))) > 0
    reason = F.when(loose, "not one sentence on claims of its section").when(mute, "attribution missing").when(fresh, "unlicensed number").when(~F.coalesce("accepted", F.lit(False)), "not accepted")
    return full.select(*key, "text", F.array_distinct("claim_ids").alias("claims"), reason.alias("reason"))


def report(title: str, as_of: str, sections: DataFrame, printed: DataFrame, citations: DataFrame, gaps: DataFrame) -> DataFrame:
    """The report as lines (part, place, seq, line) in order; citations follow their text.

    sections: section_id, title, order; printed: section_id, seq, text, refs (sorted evidence ids); citations: evidence_id,
    title, publisher, published_at, locator, url; gaps: place, question, missing. A sentence ends with one full stop and its
    references; a section without sentences and a report without gaps say so; only what is referred to is cited.
    """
    line = lambda rows, part, place, seq, text: rows.select(F.lit(part).alias("part"), place.cast("long").alias("place"), seq.cast("long").alias("seq"), text.alias("line"))
    none, one = F.lit(0), sections.sparkSession.range(1)
    refs = F.array_join(F.transform("refs", lambda r: F.concat(F.lit("[^"), r.cast("string"), F.lit("]"))), "")
    spoken = printed.join(sections.select("section_id", "order"), "section_id")
    silent = sections.join(printed.select("section_id"), "section_id", "left_anti")
    used = printed.select(F.explode("refs").alias("evidence_id")).distinct()
    cited = citations.join(used, "evidence_id", "left_semi")
    note = F.concat(F.lit("[^"), F.col("evidence_id").cast("string"), F.lit("]: "), F.concat_ws("，", "title", "publisher", F.col("published_at").cast("string"), "locator"), F.lit("。"), "url")
    parts = [
        line(one, 0, none, none, F.lit(f"# {title}研究报告")),
        line(one, 0, none, F.lit(1), F.lit(f"资料截止：{as_of}（北京时间）。仅呈现可追溯的研究内容；未解决问题见附录。")),
        line(sections, 1, F.col("order"), F.lit(-1), F.concat(F.lit("## "), "title")),
        line(spoken, 1, F.col("order"), F.col("seq"), F.concat(F.regexp_replace("text", "。+$", ""), F.lit("。"), refs)),
        line(silent, 1, F.col("order"), none, F.lit("本节尚无通过证据与推论检查的可写结论。")),
        line(one, 2, F.lit(-1), none, F.lit("## 未解决的研究问题")),
        line(gaps, 2, F.col("place"), none, F.concat(F.lit("- "), "question", F.lit("："), "missing")),
        line(one.join(gaps.select(F.lit(0).cast("long").alias("id")).distinct(), "id", "left_anti"), 2, none, none, F.lit("- 无已识别的开放问题；这不代表材料已穷尽。")),
        line(one, 3, F.lit(-1), none, F.lit("## 来源与证据定位")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.union(line(cited, 3, none, F.lit(0), note)).orderBy("part", "place", "seq", "line")
