"""The two end-to-end workflows, each scan -> review -> apply."""
