"""Pause, resume and stop of a running job through a small file on shared storage."""

from __future__ import annotations

import os
import time

STATES = ["RUNNING", "PAUSED", "STOPPED"]


class Control:
    """One state in a file: another process (or thread) sets it, the job reads it between its waves. No file: RUNNING."""

    def __init__(self, path: str, poll: float = 0.2) -> None:
        self.path, self.poll = path, poll

    def set(self, state: str) -> None:
        """Whole or not at all: a reader sees the old state or the new one."""
        if state not in STATES:
            raise ValueError(f"unknown state {state!r}")
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(f"{self.path}.tmp", "w", encoding="utf-8") as f:
            f.write(state)
        os.replace(f"{self.path}.tmp", self.path)

    def pause(self) -> None:
        self.set("PAUSED")

    def resume(self) -> None:
        self.set("RUNNING")

    def stop(self) -> None:
        self.set("STOPPED")

    @property
    def state(self) -> str:
        try:
            with open(self.path, encoding="utf-8") as f:
                return f.read().strip() or "RUNNING"
        except FileNotFoundError:
            return "RUNNING"

    def go_on(self) -> bool:
        """Waits while PAUSED; False once STOPPED."""
        while (state := self.state) == "PAUSED":
            time.sleep(self.poll)
        return state != "STOPPED"

    def gate(self) -> Gate:
        return Gate(self.path)


class Gate:
    """What a task asks before each file (and each block of a large one). It looks at the control file every ``every`` seconds at most."""

    def __init__(self, path: str | None, every: float = 0.1) -> None:
        self.path, self.every, self.at, self.last = path, every, -every, True

    def go_on(self) -> bool:
        """Waits while the job is PAUSED; False once it is STOPPED. Without a control file always True."""
        if self.path is None or not self.last:
            return self.last
        if (now := time.monotonic()) - self.at >= self.every:
            self.last = Control(self.path, self.every).go_on()
            self.at = now if self.last else self.at
        return self.last
