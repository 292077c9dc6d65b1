"""A background worker for the queue of documents that wait to be embedded."""

from __future__ import annotations

import threading
import time
from typing import Any


class QueueWorker:
    """Takes up to ``at_once`` tasks in each job, by priority, as long as there are any; one Spark job embeds them all."""

    def __init__(self, engine: Any, at_once: int = 5, poll: float = 0.5):
        self.engine, self.at_once, self.poll = engine, max(1, at_once), poll
        self._stop, self._drain, self._thread = threading.Event(), False, None
        self.done, self.errors = 0, []

    def start(self) -> None:
        if self._thread is None or not self._thread.is_alive():
            self._stop.clear()
            self._thread = threading.Thread(target=self._run, name="quillspark-queue", daemon=True)
            self._thread.start()

    @property
    def running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def _run(self) -> None:
        while True:
            try:
                n = self.engine.process_pending(self.at_once)
            except Exception as e:  # noqa: BLE001  the worker outlives a failed job; its tasks go back to the queue
                self.errors.append(str(e)[:500])
                n = 0
            self.done += n
            if self._stop.is_set() and (not n or not self._drain):
                return
            if not n:
                self._stop.wait(self.poll)

    def stop(self, drain: bool = True, timeout: float = 30.0) -> bool:
        """Ends after the running job or, draining, when nothing waits; whether it has ended in time."""
        self._drain = drain
        self._stop.set()
        if self._thread is not None:
            self._thread.join(timeout)
        return not self.running

    def unfinished(self) -> int:
        """Tasks that wait or run."""
        return self.engine.unfinished()

    def wait_empty(self, timeout: float = 60.0) -> bool:
        end = time.monotonic() + timeout
        while self.unfinished():
            if time.monotonic() > end:
                return False
            time.sleep(self.poll)
        return True
