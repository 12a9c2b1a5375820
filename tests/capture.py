"""Captures that CameraSource can import: three frames a camera, then no more; and cameras that go on."""

import itertools
import time


def three(camera):
    left = [(float(i), 2, 1, 3, bytes([camera, i] * 3)) for i in (1, 2, 3)]
    return lambda: left.pop(0) if left else None


def endless(camera):
    """A frame each hundredth of a second; camera 9 gives none."""
    number = itertools.count(1)

    def capture():
        time.sleep(0.01)
        while camera == 9:
            time.sleep(0.05)
        return time.time(), 2, 1, 3, next(number).to_bytes(6, "big")

    return capture
