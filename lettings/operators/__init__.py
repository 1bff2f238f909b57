"""DataFrame operators: frames in, frame out, nothing collected."""
