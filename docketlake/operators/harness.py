"""A command-line model as a classifier: retries, back-off, waiting out a usage limit, and reading its answer."""

from __future__ import annotations

import json
import re
import subprocess
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from docketlake.operators.classify import Classifier
from docketlake.schema import WITHDRAWN

# Attempts, seconds, and what a usage limit looks like.
RETRIES, TIMEOUT, BACKOFF, BACKOFF_CAP, LIMIT_POLL = 3, 120.0, 5.0, 60.0, 300.0
USAGE_LIMIT = re.compile(r"usage limit|rate limit|limit reached|too many requests|\b429\b", re.I)
STRICTER = "\n\nYour last answer was not valid. Reply with ONLY one JSON object, no prose and no code fence."


class UsageLimit(Exception):
    """The model's allowance is used up; the call is repeated later and doesn't count as an attempt."""


def prompt_of(title: str, body: str | None, flair: str | None, op_comments: str | None) -> str:
    """The same text as ``functions.derive.user_prompt``."""
    shown = "[body unavailable]" if not body or body in WITHDRAWN else body
    comments = (op_comments or "").strip()
    intro = "\n\nOP's own comments on this post, sometimes with parent-comment context (authoritative detail about the same case):\n"
    return f"Flair: {flair or 'none'}\nTitle: {title or ''}\n\nBody:\n{shown}{intro + comments if comments else ''}\n\nExtract the structured data as a single JSON object."


def object_in(text: str) -> dict | None:
    """The JSON object in an answer: all of it, else a fenced block, else from the first to the last brace."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in (text, fenced and fenced[1], text[text.find("{") : text.rfind("}") + 1]):
        try:
            if isinstance(found := json.loads(part or ""), dict):
                return found
        except ValueError:
            continue
    return None


def read_answer(stdout: str) -> tuple[dict | None, float | None]:
    """(object, cost) of a tool's output: its structured output, else the object in its result, else in all of it."""
    try:
        outer = json.loads(stdout)
    except ValueError:
        outer = None
    if not isinstance(outer, dict):
        return object_in(stdout), None
    cost = outer.get("total_cost_usd")
    if isinstance(outer.get("structured_output"), dict):
        return outer["structured_output"], cost
    if isinstance(outer.get("result"), str):
        return object_in(outer["result"]), cost
    return outer, cost


def run_command(argv: Sequence[str], prompt: str, timeout: float) -> tuple[int, str, str]:
    """(exit code, output, errors) of a command that reads the prompt; TimeoutError if it takes too long."""
    try:
        done = subprocess.run([*argv], input=prompt, capture_output=True, text=True, timeout=timeout)
    except subprocess.TimeoutExpired as e:
        raise TimeoutError(f"no answer in {timeout:g} s") from e
    return done.returncode, done.stdout, done.stderr


@dataclass
class CommandClassifier(Classifier):
    """Runs ``argv`` with the prompt on its input. The reason of the last failed attempt is the post's."""

    argv: Sequence[str]
    name: str = "command"
    model: str = ""
    retries: int = RETRIES
    timeout: float = TIMEOUT
    run: Callable[[Sequence[str], str, float], tuple[int, str, str]] = run_command
    sleep: Callable[[float], None] = time.sleep

    def _once(self, prompt: str) -> tuple[dict, float | None, str]:
        code, out, err = self.run(self.argv, prompt, self.timeout)
        if code:
            if USAGE_LIMIT.search(out + err):
                raise UsageLimit(out + err)
            raise RuntimeError(f"exit code {code}: {err.strip()[:200]}")
        found, cost = read_answer(out)
        if found is None:
            if USAGE_LIMIT.search(out):
                raise UsageLimit(out)
            raise ValueError("no JSON object in the answer")
        return found, cost, out

    def classify(self, *, title: str, body: str | None, flair: str | None, op_comments: str | None) -> dict:
        prompt, attempt, strict, problem = prompt_of(title, body, flair, op_comments), 0, "", "no attempt"
        while attempt < self.retries:
            try:
                found, cost, out = self._once(prompt + strict)
                return {"status": "ok", "fields_json": json.dumps(found), "model": self.model or None, "raw_output": out, "cost_usd": cost}
            except UsageLimit:
                self.sleep(LIMIT_POLL)
                continue
            except TimeoutError as e:
                problem = str(e)
                if attempt + 1 < self.retries:
                    self.sleep(min(BACKOFF_CAP, BACKOFF * 2**attempt))
            except ValueError as e:
                problem, strict = str(e), STRICTER
            except (RuntimeError, OSError) as e:
                problem = str(e)
            attempt += 1
        return {"status": "failed", "failure_reason": problem, "model": self.model or None}
