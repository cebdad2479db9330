class Worker:
    @staticmethod
    def run():
        return process()


async def fetch(url, lock):
    import aiohttp

    async with lock:
        lock.acquire()
        return await aiohttp.get(url)


def main():
    fetch("x", None)
