"""Training-data operators: each works on whole tables of any size; see the modules for their contracts."""
