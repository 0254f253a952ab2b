"""Evaluation parameters and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fixed values of the public keypoint evaluation protocol.
OKS_SIGMAS = [0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089]

#: Flags that a 64-bit word holds in rows of bits.
WORD = 62


@dataclass(frozen=True)
class Params:
    """What is evaluated: thresholds, area ranges (closed at both ends) and detection caps per image and category."""

    iou_thrs: tuple[float, ...] = tuple(0.5 + 0.05 * i for i in range(10))
    rec_thrs: tuple[float, ...] = tuple(i / 100.0 for i in range(101))
    max_dets: tuple[int, ...] = (1, 10, 100)
    areas: tuple[tuple[str, float, float], ...] = field(default=(("all", 0.0, 1e10), ("small", 0.0, 1024.0), ("medium", 1024.0, 9216.0), ("large", 9216.0, 1e10)))
    use_cats: bool = True

    def __post_init__(self):
        if not self.max_dets or not self.iou_thrs or not self.areas:
            raise ValueError("max_dets, iou_thrs and areas must not be empty")

    @classmethod
    def keypoints(cls) -> Params:
        return cls(max_dets=(20,), areas=(("all", 0.0, 1e10), ("medium", 1024.0, 9216.0), ("large", 9216.0, 1e10)))

    @classmethod
    def federated(cls) -> Params:
        return cls(max_dets=(300,))

    @classmethod
    def open_images(cls) -> Params:
        return cls(iou_thrs=(0.5,), areas=(("all", 0.0, 1e10),), max_dets=(100,))
