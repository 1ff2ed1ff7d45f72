"""Fixed values and settings of the recording pipeline."""

from __future__ import annotations

from dataclasses import dataclass

# Channel names that aren't of the scalp montage, by parts of their names.
AUXILIARY = ("ECG", "EKG", "VNS", "SCL", "PHOTIC", "STI", "X1", "X2", "PULSE", "RESP", "TEMP", "EMG", "EOG")
# The standard bipolar montage, in order.
MONTAGE = (
    "FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FP2-F4",
    "F4-C4", "C4-P4", "P4-O2", "FP2-F8", "F8-T8", "T8-P8", "P8-O2", "FZ-CZ", "CZ-PZ",
)


@dataclass(frozen=True)
class Config:
    """One object for all steps, so that no step runs with other folders or limits than the rest."""

    least_channels: int = 10
    low_hz: float = 0.5
    high_hz: float = 45.0
    high_cap: float = 0.95  # of the Nyquist rate
    zscore_eps: float = 1e-12
    target_hz: float = 256.0
    rate_tolerance: float = 1e-6
    epoch_sec: float = 2.0
    stack: int = 3
    overlap: float = 0.5
    ictal_overlap: float = 0.5
    margin_sec: float = 30.0
    bands: int = 8
    band_low: float = 0.5
    band_high: float = 25.0
    refractory_sec: float = 30.0
    tolerance_sec: float = 5.0
    neighbours: int = 5
    ica_components: int = 20
    ica_iterations: int = 500
    eye_threshold: float = 3.0
    muscle_threshold: float = 0.9

    @property
    def step(self) -> int:
        """Epochs from one stack to the next: stack * (1 - overlap), rounded half to even, 1 at least."""
        return max(1, round(self.stack * (1 - self.overlap)))


DEFAULT = Config()
MODELS = ("logistic_regression", "random_forest", "knn", "svm")


def selected_models(model: str = "all", include_svm: bool = False) -> tuple[str, ...]:
    """Models of a batch: one by name, or all but the kernel machine unless that is asked for."""
    if model != "all":
        return (model,)
    return MODELS if include_svm else MODELS[:-1]
