"""All registered queries; importing the modules registers them."""

from voxspark.plans import q_audio, q_inference, q_jobs, q_phrases, q_recordings, q_speakers, q_text  # noqa: F401
from voxspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
