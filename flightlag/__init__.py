"""Delay-propagation analytics on PySpark DataFrames."""

from flightlag.plans.warehouse import Warehouse
from flightlag.session import build_session, pin_session
from flightlag.settings import Settings

__all__ = ["Settings", "Warehouse", "build_session", "pin_session"]
