"""Operators on collections (``collection``), traces (``trace``) and fixpoints (``iterate``)."""
