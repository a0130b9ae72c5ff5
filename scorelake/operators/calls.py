"""How calls of systems outside are made: several at a time in a partition, each with a deadline."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator

#: Answers that wait for an earlier call to end, for each thread; beyond it no further call begins.
AHEAD = 16


class _Call:
    def __init__(self, task: Callable[[], object], changed: threading.Condition):
        self.task, self.changed, self.began = task, changed, time.monotonic()
        self.done, self.late, self.answer, self.error = False, False, None, None
        threading.Thread(target=self._run, daemon=True).start()  # a thread that hangs doesn't keep the worker alive

    def _run(self) -> None:
        answer = error = None
        try:
            answer = self.task()
        except Exception as e:
            error = e
        with self.changed:
            self.answer, self.error, self.done = answer, error, True
            self.changed.notify_all()


def answers(inputs: Iterable, call: Callable, threads: int = 1, seconds: float | None = None, late: Callable = lambda x: None) -> Iterator:
    """call(x) for each input, ``threads`` at a time, in the order of the inputs.

    A call that takes more than ``seconds`` is given up: its answer is late(x), and its thread's place is free for
    the next call, so a hanging call costs its own row and time only. What it may still answer is
    dropped. Inputs are read as calls begin, and at most AHEAD answers for each thread wait for their turn. An
    error that a call raises is raised in its turn.
    """
    changed, source = threading.Condition(), iter(inputs)
    waiting: deque[tuple[object, _Call]] = deque()
    more = True
    while more or waiting:
        with changed:
            now = time.monotonic()
            for _, c in waiting:
                c.late = c.late or (not c.done and seconds is not None and now - c.began >= seconds)
            running = sum(not c.done and not c.late for _, c in waiting)
        while more and running < threads and len(waiting) < AHEAD * threads:
            try:
                x = next(source)
            except StopIteration:
                more = False
                break
            waiting.append((x, _Call(lambda x=x: call(x), changed)))
            running += 1
        while waiting and (waiting[0][1].done or waiting[0][1].late):
            x, c = waiting.popleft()
            if c.late:
                yield late(x)
            elif c.error is not None:
                raise c.error
            else:
                yield c.answer
        if not waiting:
            continue
        with changed:
            head = waiting[0][1]
            running = [c for _, c in waiting if not c.done and not c.late]
            if not head.done and len(running) >= min(threads, len(waiting)) or not more or len(waiting) >= AHEAD * threads:
                ends = [c.began + seconds for c in running] if seconds is not None else []
                if running and not head.done:
                    changed.wait(max(0.0, min(ends) - time.monotonic()) if ends else None)
