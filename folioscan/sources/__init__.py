"""Tables that operators read, and views that fill them."""
