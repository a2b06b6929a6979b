"""Image operators as DataFrame transformations.

A gray image is rows of (keys, y, x, v), a color image rows of (keys, y, x, r, g, b); `keys` name the image and may be
any columns, so every operator works on batches of images at once.
"""
