"""Audits of arriving documents."""
