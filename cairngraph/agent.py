"""The agent protocol around the graph functions, with the model as an injected callable."""

from __future__ import annotations

import ast
import contextlib
import io
import json
import random
import re
import time
import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from .functions.canonical import serialize_final

OUTPUT_TAIL = 10_000
SUB_QUERIES = 20
_BLOCK = re.compile(r"```(?:python|repl)?[ \t]*\n(.*?)```", re.DOTALL)
_STANDALONE = re.compile(r"(?<![A-Za-z0-9])[QP]\d+(?![A-Za-z0-9])")


class Final(Exception):
    """Carries the submitted answer out of a cell."""

    def __init__(self, value: Any):
        super().__init__("final")
        self.value = value


class BudgetExhausted(RuntimeError):
    """More reads than the budget allows."""


class ReadLog:
    """Calls of one run with their charges: the sequential form of ``operators.ledger.charges``."""

    def __init__(self, budget: int | None = None):
        self.budget, self.spent = budget, 0
        self.calls: list[dict] = []
        self.seen: set[str] = set()
        self.opened: set[str] = set()

    def add(self, fn: str, args: Sequence[Any], ids: Sequence[str], free: bool = False) -> None:
        self.calls.append({"fn": fn, "args": list(args), "ids": sorted(set(ids))})
        fresh = bool(set(ids) - self.seen)
        self.seen |= set(ids)
        if fn == "edges":
            free = free or args[0] in self.opened
            if args[1] == "both" and args[2] in (None, "", "None"):
                self.opened.add(args[0])
        self.spent += not (free or fn in ("reads_left", "degree") or (fn in ("name", "has", "rank") and not fresh))
        if self.budget is not None and self.spent > self.budget:
            raise BudgetExhausted(f"{self.budget} reads are used; answer from what was read")

    def left(self) -> int | None:
        return None if self.budget is None else max(0, self.budget - self.spent)


def cells(message: str) -> list[str]:
    """Code blocks of a reply that parse as Python.  Of several, those that only submit a literal answer don't count."""
    parsed = []
    for block in _BLOCK.findall(message):
        if block.strip():
            with contextlib.suppress(SyntaxError):
                parsed.append((block, ast.parse(block)))
    if len(parsed) > 1:
        parsed = [(b, t) for b, t in parsed if not submits_literal(t)]
    return [b for b, _ in parsed]


def submits_literal(tree: ast.Module) -> bool:
    match tree.body:
        case [ast.Expr(ast.Call(ast.Name("FINAL" | "FINAL_VAR"), [argument], []))]:
            try:
                ast.literal_eval(argument)
            except (ValueError, TypeError):
                return False
            return True
    return False


def run_cell(code: str, names: dict[str, Any]) -> str:
    """Runs a cell in ``names``, echoes a trailing expression, and returns the tail of what it printed; Final passes through."""
    tree = ast.parse(code)
    last = tree.body.pop() if tree.body and isinstance(tree.body[-1], ast.Expr) else None
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        try:
            exec(compile(tree, "<cell>", "exec"), names)
            if last is not None:
                value = eval(compile(ast.Expression(last.value), "<cell>", "eval"), names)
                if value is not None:
                    print(value)
        except Final:
            raise
        except NameError as e:
            hint = f" (write {e.name!r} in quotes)" if e.name and re.fullmatch(r"[QP]\d+", e.name) else ""
            print(f"NameError: {e}{hint}")
        except Exception:
            print(traceback.format_exc(limit=1))
    return out.getvalue()[-OUTPUT_TAIL:]


def segments(message: str) -> list[tuple[str, str]]:
    """(kind, text) pieces of a reply: prose is thought, a block that compiles is code, any other block an artifact."""
    out, at = [], 0
    for m in re.finditer(r"```[^\n]*\n(.*?)(?:```|\Z)", message, re.DOTALL):
        if (prose := message[at : m.start()].strip()):
            out.append(("thought", prose))
        try:
            compile(m[1], "<cell>", "exec")
            out.append(("code", m[1]))
        except SyntaxError:
            out.append(("artifact", m[1]))
        at = m.end()
    if (prose := message[at:].strip()):
        out.append(("thought", prose))
    return out


def shape_fault(answer: str, expected: Any) -> str | None:
    """What is wrong with an answer's JSON type, keys or id fields; values are never compared."""
    if expected is None:
        return None
    text = re.sub(r"^```[a-z]*\s*|\s*```$", "", answer.strip())
    try:
        got = json.loads(text)
    except ValueError as e:
        return f"not valid JSON: {e}"
    if isinstance(expected, dict) != isinstance(got, dict) or isinstance(expected, list) and not isinstance(got, list):
        return f"expected {type(expected).__name__}, got {type(got).__name__}"
    if isinstance(expected, dict):
        if set(expected) != set(got):
            return f"keys: missing {sorted(set(expected) - set(got))}, unexpected {sorted(set(got) - set(expected))}"
        named = sorted(k for k, v in expected.items() if _all_ids(v) and _strings(got[k]) and not _all_ids(got[k]))
        if named:
            return f"labels where ids are expected: {named}"
    return None


def _strings(value: Any) -> list[str]:
    if isinstance(value, str):
        return [value]
    return [x for v in (value if isinstance(value, list) else []) for x in _strings(v)]


def _all_ids(value: Any) -> bool:
    found = _strings(value)
    return bool(found) and all(re.fullmatch(r"[QP]\d+", x) for x in found)


def ungrounded_ids(answer: str, question: str, seen: set[str]) -> list[str]:
    """Ids of an answer that no read returned and the question doesn't name."""
    return sorted(set(_STANDALONE.findall(answer)) - seen - set(_STANDALONE.findall(question)))


def recalled_ids(code: str, question: str, seen: set[str]) -> list[str]:
    """Ids that a cell states as constants without having read them."""
    constants = {n.value for n in ast.walk(ast.parse(code)) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    return sorted({x for c in constants for x in _STANDALONE.findall(c)} - seen - set(_STANDALONE.findall(question)))


def closest_quote(quoted: str, stored: Sequence[str]) -> str | None:
    """The longest stored text inside a quotation: what a wrapped quotation should have been."""
    return max((s for s in stored if s and s in quoted), key=len, default=None)


def map_over(query: Callable[[str], str], items: dict | Sequence, instruction: str, batch: int = 10) -> dict[str, str]:
    """One verdict per item, asked in batches; a key without an answer line gets NO ANSWER."""
    pairs = [(str(k), v) for k, v in (items.items() if isinstance(items, dict) else enumerate(items))]
    out: dict[str, str] = {}
    for at in range(0, len(pairs), max(1, batch)):
        part = pairs[at : at + max(1, batch)]
        reply = query(instruction + "\nOne line per item, KEY<TAB>ANSWER:\n" + "\n".join(f"{k}\t{v}" for k, v in part))
        lines = dict((k.strip(), v.strip()) for k, tab, v in (x.partition("\t") for x in reply.splitlines()) if tab)
        out |= {k: lines.get(k, "NO ANSWER") for k, _ in part}
    return out


def with_retry(call: Callable[[], str], retryable: Callable[[Exception], bool], tries: int = 3, low: float = 10.0, high: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls again on errors that may pass, after a wait that doubles from ``low`` up to ``high``."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:
            if n + 1 == tries or not retryable(e):
                raise
            sleep(min(high, low * 2**n) * (1 + 0.1 * random.random()))
    raise AssertionError


def stop_strings(thinking: bool) -> list[str]:
    """The closing fence ends a turn only when the model doesn't think aloud."""
    return [] if thinking else ["\n```\n"]


def restore_fence(reply: str) -> str:
    """Closes a block whose fence was eaten as a stop string."""
    return reply + "\n```" if reply.count("```") % 2 else reply


def build_prompt(core: str, docs: dict[str, str], allowed: Sequence[str], answer_format: str) -> str:
    return "\n\n".join([core, *[docs[name] for name in allowed], f"Answer format: {answer_format}"])


@dataclass
class Run:
    status: str = "max_iters"
    answer: str | None = None
    turns: int = 0
    messages: list[dict] = field(default_factory=list)
    sub_queries: int = 0


def run_loop(model: Callable[[list[dict]], str], prompt: str, question: str, functions: dict[str, Callable], turns: int, expected: Any = None, sub_query: Callable[[str], str] | None = None, limit: int = SUB_QUERIES, checkpoint: Callable[[Run], None] | None = None) -> Run:
    """Turns of reply, cell and observation until FINAL; ends as final, max_iters, interrupted or crashed:<error>."""
    run = Run(messages=[{"role": "system", "content": prompt}, {"role": "user", "content": question}])

    def final(value: Any) -> None:
        raise Final(value)

    def ask(text: str) -> str:
        if sub_query is None or run.sub_queries >= limit:
            raise RuntimeError("no sub-queries left")
        run.sub_queries += 1
        return sub_query(text)

    names: dict[str, Any] = {**functions, "FINAL": final, "FINAL_VAR": lambda n: final(names[n]), "llm_query": ask, "llm_map": lambda items, instruction, batch=10: map_over(ask, items, instruction, batch)}
    try:
        while run.turns < turns:
            reply = restore_fence(model(run.messages))
            run.turns += 1
            run.messages.append({"role": "assistant", "content": reply})
            found = cells(reply)
            if len(found) != 1:
                seen = "no code cell" if not found else f"{len(found)} code cells"
                observation = f"A turn needs exactly one code cell; this one has {seen}."
            else:
                try:
                    observation = run_cell(found[0], names)
                except Final as e:
                    answer = serialize_final(e.value)
                    fault = shape_fault(answer, expected)
                    if fault is None:
                        run.status, run.answer = "final", answer
                        return run
                    observation = f"Not accepted: {fault}"
            run.messages.append({"role": "user", "content": observation})
            if checkpoint:
                checkpoint(run)
    except KeyboardInterrupt:
        run.status = "interrupted"
    except Exception as e:
        run.status = f"crashed:{type(e).__name__}"
    return run
