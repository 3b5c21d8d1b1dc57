"""Registered queries; importing this package fills the registry."""

from gridloom.plans.registry import REGISTRY  # noqa: F401
from gridloom.plans import sources  # noqa: E402,F401
from gridloom.plans import joins_q  # noqa: E402,F401
from gridloom.plans import panel_q  # noqa: E402,F401
from gridloom.plans import recon_q  # noqa: E402,F401
from gridloom.plans import uncertainty_q  # noqa: E402,F401
from gridloom.plans import model_q  # noqa: E402,F401
