"""All named queries; importing this module fills the registry."""

from . import boards, evaluation, files, live, localization, logs, matching, sequences, signals, telemetry  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
