"""Continuous modes: streams over folders of raw documents."""
