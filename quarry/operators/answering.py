"""Many questions answered in rounds: retrieve, grade, write anew or answer, verify.

A round is one plan for all questions that are still open. Questions leave the loop as their route is
decided; the number of rounds is bounded, so the loop always ends. Model calls are made per question on the
driver's side of a provider, for questions alone, never for the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators.answers import REFUSAL
from quarry.operators.retrieval import merge_rounds
from quarry.providers import structured_chat

#: Earlier messages that a question is read with, and characters of each.
PAST, PAST_CHARS = 6, 300
#: Prompts by task; what is in braces is filled in.
PROMPTS = {
    "contextualise": "Earlier messages:\n{past}\n\nWrite the last question so that it can be understood alone. Give only the question.\nQuestion: {question}",
    "grade": 'Question: {question}\n\nPassages:\n{context}\n\nDo the passages suffice to answer? Reply with JSON: {{"verdict": "sufficient" or "insufficient"}}',
    "rewrite": "A search for this question found too little: {question}\nGive one other wording for the search, nothing else.",
    "answer": "Question: {question}\n\nPassages:\n{context}\n\nAnswer from the passages alone and cite them by number in brackets.",
    "translate": "Translate into {target}, nothing else: {text}",
    "summarise": "Sum up in two sentences what was asked and what was found:\n{past}",
}


@dataclass
class State:
    """What is known of a question while it is worked on."""

    query_id: int
    question: str
    query: str
    history: list[dict] = field(default_factory=list)
    tries: int = 0
    route: str | None = None
    answer: str = ""
    verdict: str | None = None
    chunks: list[dict] = field(default_factory=list)
    citations: list[int] = field(default_factory=list)
    invalid: list[int] = field(default_factory=list)
    verified: bool = False
    trace: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        """The state as plain values, to be stored or sent."""
        return dict(self.__dict__)

    @classmethod
    def of(cls, values: dict) -> State:
        return cls(**values)


def standalone(state: State, model) -> str:  # noqa: ANN001
    """The question as it can be searched alone; itself without history or model, or if the model's wording is no question."""
    past = [m for m in state.history if m.get("role") in ("user", "assistant") and m.get("content")][-PAST:]
    if not past or not model.enabled:
        return state.question
    said = "\n".join(f"{m['role']}: {m['content'][:PAST_CHARS]}" for m in past)
    try:
        new = (model.chat([{"role": "user", "content": PROMPTS["contextualise"].format(past=said, question=state.question)}])["content"] or "").strip()
    except Exception as e:  # noqa: BLE001  the question can be searched as it is
        state.trace.append(f"contextualise failed: {type(e).__name__}")
        return state.question
    return new if acceptable(new, state.question) else state.question


def acceptable(new: str, old: str) -> bool:
    """Whether a new wording may replace a question: not empty, not far longer, no list of keywords."""
    pieces = [x for x in re.split(r"[\s,，、;；]+", new) if re.search("[㐀-鿿]", x)]
    asks = re.search(r"[?？]|什么|怎么|如何|哪|吗|为什么|多少|是否", new)
    return bool(new) and len(new) <= 4 * len(old) + 50 and not (len(pieces) >= 4 and not asks)


def grade(state: State, model) -> str | None:  # noqa: ANN001
    """``sufficient`` or ``insufficient``; null if it could not be told."""
    try:
        return structured_chat(model, [{"role": "user", "content": PROMPTS["grade"].format(question=state.question, context=context_of(state))}], {"verdict": str})["verdict"]
    except Exception as e:  # noqa: BLE001  then what was found is used
        state.trace.append(f"grade failed: {type(e).__name__}")
        return None


def context_of(state: State) -> str:
    return "\n\n".join(f"[{i}] {c['content']}" for i, c in enumerate(state.chunks, 1))


def routed(state: State, limit: int, has_model: bool) -> str:
    """Next step after grading: answer with what was found, word the search anew while tries are left, or refuse."""
    left = state.tries < limit
    if not state.chunks:
        return "rewrite" if left else "refuse"
    if not has_model or state.verdict in (None, "sufficient"):
        return "generate"
    return "rewrite" if left else "refuse"


def finish(state: State, model) -> State:  # noqa: ANN001
    """Answer or refuse, and check the citations."""
    if state.route == "refuse":
        state.answer, state.verified = REFUSAL, True
        return state
    state.route = "generate"
    if model.enabled:
        try:
            state.answer = model.chat([{"role": "user", "content": PROMPTS["answer"].format(question=state.question, context=context_of(state))}])["content"].strip()
        except Exception as e:  # noqa: BLE001  the best passage is an answer too
            state.trace.append(f"answer failed: {type(e).__name__}")
    if not state.answer:
        state.answer = f"{state.chunks[0]['content']} [1]"
    said = list(dict.fromkeys(int(n) for n in re.findall(r"\[(\d+)\]", state.answer)))
    state.citations = [n for n in said if 1 <= n <= len(state.chunks)]
    state.invalid = sorted(n for n in said if n not in state.citations)
    state.verified = bool(state.citations) and not state.invalid
    return state


def answer_all(spark: SparkSession, states: list[State], retrieve: Callable[[DataFrame], DataFrame], model, rewrites: int = 2, top_k: int = 5) -> list[State]:  # noqa: ANN001
    """All questions answered in at most ``rewrites + 1`` rounds.

    ``retrieve`` gives query_id, rank, chunk_id and content for a table of query_id and text. Hits of a later
    round go behind those of earlier ones, each chunk once.
    """
    for s in states:
        s.query = standalone(s, model)
    todo, before = list(states), None
    texts: dict[int, dict[int, str]] = {s.query_id: {} for s in states}
    for _ in range(rewrites + 1):
        if not todo:
            break
        found = retrieve(spark.createDataFrame([(s.query_id, s.query) for s in todo], "query_id long, text string"))
        rows = found.select("query_id", "chunk_id", "rank", "content").collect()  # top_k for each question
        for r in rows:
            texts[r.query_id][r.chunk_id] = r.content
        fresh = spark.createDataFrame([(r.query_id, r.chunk_id, r.rank) for r in rows], "query_id long, chunk_id long, rank int")
        merged = fresh if before is None else merge_rounds(before, fresh, top_k).withColumn("rank", F.col("rank").cast("int"))
        kept = merged.collect()
        before = spark.createDataFrame([tuple(r) for r in merged.select("query_id", "chunk_id", "rank").collect()], "query_id long, chunk_id long, rank int")
        after = []
        for s in todo:
            own = sorted((r for r in kept if r.query_id == s.query_id), key=lambda r: r["rank"])
            s.chunks = [{"chunk_id": r.chunk_id, "content": texts[s.query_id][r.chunk_id]} for r in own]
            s.verdict = grade(s, model) if s.chunks and model.enabled else None
            s.route = routed(s, rewrites, model.enabled)
            s.trace.append(s.route)
            if s.route != "rewrite":
                continue
            s.tries += 1
            new = ""
            if model.enabled:
                try:
                    new = (model.chat([{"role": "user", "content": PROMPTS["rewrite"].format(question=s.question)}])["content"] or "").strip()
                except Exception as e:  # noqa: BLE001
                    s.trace.append(f"rewrite failed: {type(e).__name__}")
            if not acceptable(new, s.question) or new == s.query:  # nothing new to look for
                s.route = "generate" if s.chunks and s.verdict != "insufficient" else "refuse"
                continue
            s.query = new
            after.append(s)
        todo = after
    for s in states:
        if s.route == "rewrite":
            s.route = "refuse"
        finish(s, model)
    return states


def events(rows: DataFrame, size: int = 8) -> DataFrame:
    """Answers as a stream of events: query_id, n (from 0), event, data.

    ``rows`` has query_id, route, answer and citations (JSON text) and may have error. A start, the citations,
    one delta for each ``size`` characters, and done; an error takes the place of what follows the start.
    """
    text = F.coalesce("answer", F.lit(""))
    n = F.char_length(text)
    error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    one = lambda event, data: F.struct(F.lit(event).alias("event"), data.cast("string").alias("data"))
    none = F.array().cast("array<struct<event:string,data:string>>")
    deltas = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: one("delta", F.substr(text, i + 1, F.lit(size))))).otherwise(none)
    good = F.concat(F.array(one("start", F.col("route")), one("citations", F.coalesce("citations", F.lit("[]")))), deltas, F.array(one("done", n)))
    all_ = F.when(error.isNotNull(), F.array(one("start", F.col("route")), one("error", error))).otherwise(good)
    return rows.select("query_id", F.posexplode(all_).alias("n", "e")).select("query_id", "n", "e.event", "e.data")


def analysed(texts: DataFrame, text: str) -> DataFrame:
    """How the index reads texts: the rows with terms, empty where there is nothing to read."""
    return texts.withColumn("terms", F.coalesce(X.tokens(F.col(text)), F.array().cast("array<string>")))
